"""What is read, and the fixed record types."""
