"""Report headers, table layouts and month names.

The header names are the marketplace's report contract; the table column
names are their snake-case forms.
"""

from __future__ import annotations

import re

from pyspark.sql import types as T

# --- fixed values: must equal the report contract ---------------------------

# Required columns of the returns report (tab separated, header row).
RETURNS_HEADERS = (
    "Order ID", "Order date", "Return request date", "Return request status",
    "Amazon RMA ID", "Merchant RMA ID", "Label type", "Label cost",
    "Currency code", "Return carrier", "Tracking ID", "Label to be paid by",
    "A-to-Z Claim", "Is prime", "ASIN", "Merchant SKU", "Item Name",
    "Return quantity", "Return Reason", "In policy", "Return type",
    "Resolution", "Invoice number", "Return delivery date", "Order Amount",
    "Order quantity", "SafeT Action reason", "SafeT claim id", "SafeT claim state",
    "SafeT claim creation time", "SafeT claim reimbursement amount", "Refunded Amount",
)

# Required columns of the all-orders (sales) report; table names are the
# same words with '-' replaced by '_'.
SALES_HEADERS = (
    "amazon-order-id", "merchant-order-id", "purchase-date", "last-updated-date",
    "order-status", "fulfillment-channel", "sales-channel", "order-channel", "url",
    "ship-service-level", "product-name", "sku", "asin", "number-of-items",
    "item-status", "tax-collection-model", "tax-collection-responsible-party",
    "quantity", "currency", "item-price", "item-tax", "shipping-price",
    "shipping-tax", "gift-wrap-price", "gift-wrap-tax", "item-promotion-discount",
    "ship-promotion-discount", "ship-city", "ship-state", "ship-postal-code",
    "ship-country", "promotion-ids", "payment-method-details", "is-business-order",
    "purchase-order-number", "price-designation", "customized-url", "customized-page",
    "signature-confirmation-recommended",
)

# Sales report columns read as numbers: blank -> 0.0, unparsable -> NULL.
SALES_FLOAT_HEADERS = (
    "number-of-items", "item-price", "item-tax", "shipping-price", "shipping-tax",
    "gift-wrap-price", "gift-wrap-tax", "item-promotion-discount",
    "ship-promotion-discount",
)

# Sales report text flags: 'true' in any letter case -> true, else false.
SALES_FLAG_HEADERS = ("is-business-order", "signature-confirmation-recommended")

# Returns report integer columns; a blank or non-integer value rejects the row.
RETURNS_INT_HEADERS = ("Return quantity", "Order quantity")

# English month names in calendar order (stored in the `month` column).
MONTHS = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)

# --- derived -----------------------------------------------------------------


def snake(header: str) -> str:
    """'Merchant SKU' -> 'merchant_sku', 'A-to-Z Claim' -> 'a_to_z_claim'."""
    return re.sub(r"[^0-9a-z]+", "_", header.strip().lower()).strip("_")


RETURNS_COLUMNS = tuple(snake(h) for h in RETURNS_HEADERS)
SALES_RENAME = {h: h.replace("-", "_") for h in SALES_HEADERS}
SALES_COLUMNS = tuple(SALES_RENAME.values())

# Columns added at ingest to both tables.
DERIVED_COLUMNS = ("month", "month_no", "year", "last_updated")



def _table(columns: tuple[str, ...], kinds: dict[str, T.DataType]) -> T.StructType:
    derived = {"month": T.StringType(), "year": T.IntegerType(), "month_no": T.IntegerType(),
               "last_updated": T.TimestampNTZType()}
    # the keys of functions.keys.STORED_KEYS, beside the texts they belong to
    keys = {k: T.StringType() for c, k in (("asin", "asin_key"), ("merchant_sku", "sku_key"),
                                           ("return_reason", "reason_key")) if c in columns}
    kinds = {**dict.fromkeys(columns, T.StringType()), **kinds, **derived, **keys}
    return T.StructType([T.StructField(c, k) for c, k in kinds.items()])


# Declared layouts of the two tables.
RETURNS_SCHEMA = _table(RETURNS_COLUMNS, {snake(h): T.IntegerType() for h in RETURNS_INT_HEADERS})
SALES_SCHEMA = _table(SALES_COLUMNS, {
    **{SALES_RENAME[h]: T.FloatType() for h in SALES_FLOAT_HEADERS},
    **{SALES_RENAME[h]: T.BooleanType() for h in SALES_FLAG_HEADERS}, "quantity": T.IntegerType()})

# Display headers of the export file (CSV sink).
EXPORT_HEADERS = {"asin": "ASIN", "merchant_sku": "Merchant SKU",
                  "return_quantity": "Return quantity"}
