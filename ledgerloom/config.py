"""Vocabulary of invoices as data: labels, value shapes, section markers and table columns. Order is meaning everywhere."""

from __future__ import annotations

# Confidence bands, best first; a field without a value has the last one.
HIGH, REVIEW, LOW, NOT_FOUND = "high", "review", "low", "not_found"

# Labels of header fields, tried in this order.
LABELS: dict[str, tuple[str, ...]] = {
    "invoice_number": (r"irn\s*no\.?", "irn", r"invoice\s*number", r"invoice\s*no\.?", r"inv\s*no\.?", r"bill\s*no\.?", r"invoice\s*#"),
    "invoice_date": (r"invoice\s*date", r"bill\s*date", r"date\s*of\s*invoice", "dated"),
    "ack_number": (r"ack\s*no\.?", r"acknowledge?ment\s*no\.?"),
    "eway_bill_number": (r"e[\s\-]*way\s*bill\s*no\.?",),
    "eway_bill_date": (r"e[\s\-]*way\s*bill\s*date",),
    "fssai_number": (r"fssai\s*no\.?", "fssai"),
    "party_gstin": (r"gstin\s*no\.?", r"gstin\s*number", "gstin", r"gst\s*no\.?", r"gst\s*number"),
    "buyer_name": (r"bill\s*to", r"m\/s\.?", r"buyer\s*name", r"customer\s*name", r"consignee\s*name", r"receiver\s*name"),
    "buyer_address": ("address",),
    "subtotal_taxable": (r"taxable\s*value", r"sub\s*total", "subtotal"),
    "total_amount": (r"total\s*amount",),
    "discount_amount": (r"discount\s*amount", "discount"),
    "tcs_amount": (r"tcs\s*amount", "tcs"),
    "invoice_amount": (r"invoice\s*amount",),
    "adjustment_amount": (r"adjustment\s*amount", r"adj\.?\s*amount"),
    "invoice_total": (r"net\s*payable\s*amount", r"net\s*payable", r"grand\s*total", r"invoice\s*total", r"amount\s*payable"),
}
# Shapes of the values.
SHAPES: dict[str, str] = {
    "number": r"[0-9A-Za-z][0-9A-Za-z\/\-\.]{4,69}",
    "date": r"\d{1,4}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4}|[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{2,4}",
    "gstin": "[0-9A-Za-z]{10,15}",
    "amount": r"-?[₹$]?\s?[0-9][0-9,]*\.?[0-9]*",
    "line": r"[^\n]{2,80}",
    "code": "[0-9]{6,20}",
    "irn": "[0-9A-Fa-f]{64}",
}
# The shape of each field's value; amounts; fields that a search near the label may fill, in this order.
SHAPE_OF = {
    "invoice_number": "number", "invoice_date": "date", "ack_number": "code", "eway_bill_number": "code", "eway_bill_date": "date", "fssai_number": "code",
    "party_gstin": "gstin", "buyer_name": "line", "buyer_address": "line",
    "subtotal_taxable": "amount", "total_amount": "amount", "discount_amount": "amount", "tcs_amount": "amount", "invoice_amount": "amount", "adjustment_amount": "amount", "invoice_total": "amount",
}
AMOUNTS = tuple(f for f, s in SHAPE_OF.items() if s == "amount")
#: Header fields in the order in which they are reported.
HEADER_FIELDS = ("invoice_number", "invoice_date", "ack_number", "eway_bill_number", "eway_bill_date", "fssai_number", "party_name", "party_gstin", "buyer_name", "buyer_address", *AMOUNTS)
# A vendor's signature line, and a number on the line after its label.
VENDOR_LINE = r"^[ \t]*for[ \t]+([A-Za-z0-9][^\n]{2,80})[ \t]*$"
NEXT_LINE_NUMBER = r"(?:irn\s*no\.?|irn)[ \t]*[:\-#]?[ \t]*\n[ \t]*([0-9A-Za-z]{20,70})"
FALLBACK_FIELDS = ("ack_number", "eway_bill_number", "eway_bill_date", "fssai_number", "invoice_date")

# Markers of sections, those of buyers before those that are left out; longest run of rows of each kind.
SECTIONS: dict[str, tuple[str, ...]] = {
    "buyer": (r"customer\s*details", r"consignee\s*details", r"bill\s*to", r"ship\s*to", r"buyer\s*details", r"buyer\s*information", r"details\s*of\s*receiver", r"receiver\s*details"),
    "exclude": (r"terms\s*(?:&|and)\s*condition", r"terms?\s*of\s*(?:sale|delivery|payment)", "disclaimer", "declaration"),
}
SECTION_ROWS = {"buyer": 10}
SECTION_STOPS: dict[str, tuple[str, ...]] = {
    "buyer": (*LABELS["total_amount"], *LABELS["invoice_total"], *LABELS["subtotal_taxable"], r"^\s*for\s+[A-Za-z]", "description.{0,40}(?:hsn|qty|quantity|rate)"),
}
# Rows that end a table of items.
TABLE_STOPS: tuple[str, ...] = (
    *(x for f in ("total_amount", "invoice_total", "discount_amount", "tcs_amount", "invoice_amount", "adjustment_amount", "ack_number", "invoice_number") for x in LABELS[f]),
    r"(?:amount|value)\s*\(in\s*words\)", r"authorised\s*signatory", r"terms\s*(?:&|and)\s*condition", r"adj\.?\s*details", r"@\s*\d+\s*%", r"dr\s*/\s*cr",
    r"auto\s*adjustment", r"warranty\s*:", r"manufacturing\s*address", r"remarks\s*:", r"instruction\s*to\s*customer",
)

# Table columns and the words that name them, the more specific first.
COLUMNS: dict[str, tuple[str, ...]] = {
    "cgst_rate": ("cgst rate", "cgst%", "cgst %"),
    "sgst_rate": ("sgst rate", "sgst%", "sgst %"),
    "igst_rate": ("igst rate", "igst%", "igst %"),
    "cgst_amount": ("cgst amt", "cgst amount", "cgst"),
    "sgst_amount": ("sgst amt", "sgst amount", "sgst"),
    "igst_amount": ("igst amt", "igst amount", "igst"),
    "discount_rate": ("disc %", "disc%", "discount %", "discount%", "discount rate", "disc rate"),
    "batch_number": ("batch",),
    "expiry_date": ("expiry", "exp date", "exp."),
    "quantity_sold": ("sold",),
    "quantity_free": ("free",),
    "quantity_total": ("total qty", "qty total"),
    "mrp_old": ("old mrp",),
    "mrp": ("new mrp", "mrp", "m.r.p."),
    "ptr": ("ptr", "p.t.r"),
    "rate_pts": ("rate pts", "rate points", "pts", "p.t.s"),
    "unit_rate": ("rate", "price"),
    "discount_amount": ("disc amt", "discount amt", "discount", "disc"),
    "taxable_value": ("taxable",),
    "item_description": ("description of goods", "product description", "goods description", "name of product", "product name", "description", "particular", "item", "product"),
    "pack": ("pack",),
    "hsn_sac": ("hsn", "sac"),
    "quantity": ("qty", "quantity"),
    "uom": ("uom", "unit"),
    "line_total": ("total", "value"),
    "sr_no": ("sr no", "sr.no", "s.no", "sl no", "sl.no", "serial no", "serial number"),
    "manufacturer": ("mfgr", "manufacturer", "mfg.", "mfrs", "mfg name"),
}
# Headers that name a column only as a whole; pairs of stacked headers with the fields of their two lines.
EXACT_COLUMNS = {"amount": "taxable_value", "net amount": "line_total"}
STACKED: tuple[tuple[str, str, str | None, str | None], ...] = (
    ("material", "hsn", None, "hsn_sac"),
    ("mfg name", "batch", None, "batch_number"),
    ("mfg date", "exp date", "mfg_date", "expiry_date"),
    ("disc", "disc", "discount_amount", "discount_rate"),
)
STACKED_TAXES = ("cgst", "sgst", "igst")
SUBROW_TOKENS = ("rate", "amount", "%", "mrp", "qty", "price")
NUMERIC_COLUMNS = (
    "quantity", "quantity_sold", "quantity_free", "quantity_total", "unit_rate", "mrp", "ptr", "rate_pts", "taxable_value", "discount_rate",
    "discount_amount", "cgst_rate", "cgst_amount", "sgst_rate", "sgst_amount", "igst_rate", "igst_amount", "line_total",
)
# Columns that are recognised but not kept, and figures of which one makes a row more than a description.
UNSTORED = ("sr_no", "mrp_old")
CORE_VALUES = ("quantity", "mrp", "ptr", "rate_pts", "unit_rate", "taxable_value", "line_total")

# Columns of a line item with their printed names, in the order of an export.
ITEM_COLUMNS: dict[str, str] = {
    "line_number": "Line #", "item_description": "Item Description", "pack": "Pack", "hsn_sac": "HSN/SAC", "manufacturer": "Manufacturer",
    "batch_number": "Batch Number", "expiry_date": "Expiry Date", "mfg_date": "Mfg Date", "quantity": "Quantity", "quantity_sold": "Qty Sold",
    "quantity_free": "Qty Free", "quantity_total": "Qty Total", "pts_original_quantity": "Original Quantity", "pts_free_quantity": "Free Quantity",
    "uom": "UOM", "unit_rate": "Unit Rate", "mrp": "MRP", "ptr": "PTR", "rate_pts": "Rate Pts", "taxable_value": "Taxable Value",
    "discount_rate": "Discount %", "discount_amount": "Discount", "cgst_rate": "CGST Rate", "cgst_amount": "CGST Amount", "sgst_rate": "SGST Rate",
    "sgst_amount": "SGST Amount", "igst_rate": "IGST Rate", "igst_amount": "IGST Amount", "line_total": "Line Total", "source_page": "Source Page",
}

# Names of months.
MONTHS: dict[str, int] = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7,
    "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}
# Shapes of written dates (day, month and year by group; 0 where there is none; whether the month is a name), tried in this order.
DATE_FORMS: tuple[tuple[str, int, int, int, bool], ...] = (
    (r"^(\d{1,2})[\/\-.](\d{1,2})[\/\-.](\d{2,4})$", 1, 2, 3, False),
    (r"^(\d{1,2})[\s\/\-.]([A-Za-z]{3,9})[\s\/\-.,]+(\d{2,4})$", 1, 2, 3, True),
    (r"^([A-Za-z]{3,9})\s+(\d{1,2}),?\s+(\d{2,4})$", 2, 1, 3, True),
    (r"^([A-Za-z]{3,9})[\s\/\-.](\d{2,4})$", 0, 1, 2, True),
    (r"^(\d{1,2})[\/\-.](\d{2,4})$", 0, 1, 2, False),
)
WHOLE_DATE = r"^\d{1,4}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4}$|^[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{2,4}$"
# How a pack stands in a description, and characters that a file name can't have.
PACK_LABEL, PACK_HYPHEN, PACK_NUMBER = r"(?i)^(.*?)\s*pack\s*size\s*:\s*(.+)$", r"^(.*\S)\s-\s*(\S+)$", r"^((?:.*\s)?)(\d\S*(?:\s+[^\d\s]\S*)*)$"
RESERVED = r'[\\/:*?"<>|]'
# Characters that count as blank at the ends of a text.
BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

# Limits.
MAX_BYTES, MAX_PAGES, MIN_TEXT, MAX_ITEMS, SAMPLE_ROWS = 100 * 1024 * 1024, 150, 20, 300, 5
ROW_RATIO, SEGMENT_GAP, OCR_GAP_RATIO, NEAR_ROWS, MIN_HEADER, SUBROW_X = 0.6, 50.0, 6.0, 3, 3, 20.0
NAME_LENGTH = 150
