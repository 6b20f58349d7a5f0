"""Fixed record types; nothing is inferred."""

from __future__ import annotations

LINE_ITEM = "struct<description: string, quantity: double, unit_price: double, amount: double>"
TEXT_FIELDS = ("invoice_number", "invoice_date", "vendor_name", "vendor_tax_id", "currency")
AMOUNT_FIELDS = ("subtotal", "tax_amount", "discount", "total")
INVOICE = ", ".join([*(f"{f} string" for f in TEXT_FIELDS), *(f"{f} double" for f in AMOUNT_FIELDS), f"line_items array<{LINE_ITEM}>"])
HEADER_FIELDS = (*TEXT_FIELDS, *AMOUNT_FIELDS)

# The states of a document and the decisions of a review.
STATUSES = ("uploaded", "processing", "extracted", "validated", "review", "completed", "failed", "escalated", "rejected")
DECISIONS = ("accept", "retry", "escalate", "reject")
STATUS_OF_DECISION = {"accept": "completed", "escalate": "escalated", "reject": "rejected", "retry": "escalated"}
FINISHED = ("completed", "escalated", "rejected")
