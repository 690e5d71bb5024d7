"""Fixed values and thresholds.

Everything in this module is a fixed value that must equal the behaviour being
reproduced (word lists, thresholds, format lists). They are stated once, here,
in their natural order, and imported everywhere else.
"""

# --- fixed values: text that means "no data" (trim + lower compared) ---------
STRING_NULL_WORDS = (
    "unknown", "error", "n/a", "na", "nan", "none", "null", "nil",
    "-", "--", "---", "missing", "?", "tbd", "tba", "undefined",
    "#n/a", "#na", "#null!", "inf", "-inf", "not available",
    "not applicable", "no data", "no value", "empty", "blank",
)

# --- fixed values: the ten null words used by the clean-enough gate ----------
GATE_NULL_WORDS = (
    "unknown", "error", "n/a", "na", "nan", "none", "null", "-", "?", "missing",
)

# --- fixed values: boolean words -------------------------------------------
BOOL_TRUE_WORDS = ("true", "1", "yes", "t", "y")
BOOL_FALSE_WORDS = ("false", "0", "no", "f", "n")
BOOL_WORDS = ("true", "false", "1", "0", "yes", "no", "t", "f", "y", "n")
BOOL_NAME_KEYWORDS = ("flag", "return", "bool", "is_", "has_", "active", "discount")
RATING_NAME_KEYWORDS = ("rating", "score", "stars", "review")

# --- fixed values: currency marks ------------------------------------------
CURRENCY_PROBE_CHARS = "₹$£€¥₩฿"
CURRENCY_LOCALE_CHARS = "$£€₹¥₩฿₺₽"

# --- fixed values: column-name words that keep a column as text -------------
NEVER_COERCE_KEYWORDS = (
    "id", "phone", "mobile", "fax", "zip", "pincode", "postcode",
    "transaction_id", "customer_id", "order_id", "invoice_id",
    "branch_id", "sales_rep", "rep", "agent", "employee",
)

# --- fixed values: date formats voted on (strptime spelling, Spark spelling) --
DATE_FORMATS = (
    ("%d-%m-%Y", "d-M-yyyy"),
    ("%m-%d-%Y", "M-d-yyyy"),
    ("%Y-%m-%d", "yyyy-M-d"),
    ("%d/%m/%Y", "d/M/yyyy"),
    ("%m/%d/%Y", "M/d/yyyy"),
    ("%Y/%m/%d", "yyyy/M/d"),
    ("%d-%m-%y", "d-M-yy"),
    ("%m-%d-%y", "M-d-yy"),
    ("%d %b %Y", "d MMM yyyy"),
    ("%b %d %Y", "MMM d yyyy"),
    ("%B %d %Y", "MMMM d yyyy"),
    ("%d %B %Y", "d MMMM yyyy"),
)
MIN_DATE_YEAR = 1990

# --- fixed values: semantic types: keywords and expected storage type --------
SEMANTIC_KEYWORDS = {
    "TransactionID": ("transaction", "order", "invoice", "bill", "receipt", "id", "trans", "txn"),
    "CustomerID": ("customer", "client", "buyer", "user", "account", "cust"),
    "ProductID": ("product", "item", "sku", "article", "prod"),
    "ProductName": ("product", "item", "name", "title", "description"),
    "Quantity": ("quantity", "qty", "units", "count", "amount", "pieces"),
    "Price": ("price", "rate", "cost", "unit", "value", "perunit"),
    "TotalAmount": ("total", "amount", "sum", "subtotal", "gross", "net", "spent", "paid"),
    "Discount": ("discount", "rebate", "offer", "promo", "coupon", "off", "applied"),
    "OrderDate": ("date", "time", "timestamp", "created", "ordered", "purchase"),
    "PaymentMethod": ("payment", "method", "type", "mode", "pay"),
    "Status": ("status", "state", "condition", "stage"),
    "Category": ("category", "type", "class", "segment", "department", "group"),
    "Location": ("location", "store", "place", "site", "venue", "shop"),
}
SEMANTIC_EXPECTED_DTYPE = {
    "TransactionID": "string",
    "CustomerID": "string",
    "ProductID": "string",
    "ProductName": "string",
    "Quantity": "integer",
    "Price": "float",
    "TotalAmount": "float",
    "Discount": "float",
    "OrderDate": "datetime",
    "PaymentMethod": "categorical",
    "Status": "categorical",
    "Category": "categorical",
}
ID_SEMANTIC_TYPES = ("CustomerID", "ProductID", "TransactionID")
STRICT_ID_SIGNALS = ("id", "cust", "txn", "num", "no", "code", "key", "ref")

# --- fixed values: relationship name fallbacks -------------------------------
QTY_NAME_WORDS = ("qty", "quantity", "units", "count", "pieces")
PRICE_NAME_WORDS = ("unitprice", "price", "rate", "cost", "perunit", "mrp")
TOTAL_NAME_WORDS = ("totalprice", "total", "spent", "amount", "sum", "subtotal", "gross", "net", "paid", "revenue")
DISCOUNT_NAME_WORDS = ("discount", "rebate", "promo", "coupon", "off")

# --- fixed values: thresholds -----------------------------------------------
MAX_NULL_PERCENT = 80.0
OUTLIER_CONTAMINATION = 0.05
PATTERN_MATCH_THRESHOLD = 0.3
EMBEDDING_THRESHOLD = 0.5
ML_MIN_TRAINING_SAMPLES = 50
ML_MAX_MISSING_PERCENT = 40.0
ML_MIN_CONTEXT_FEATURES = 2
SIMPLE_METHOD_THRESHOLD = 5.0
CONTEXT_FILLED_MIN = 0.80
IQR_FACTOR = 1.5
Z_CUT = 3.0
CORRELATION_KEEP = 0.7
FUZZY_SIMILARITY = 0.82
AUTO_CATEGORICAL_RATIO = 0.20
FORMULA_TOL_DETECT = 0.01
FORMULA_TOL_VALIDATE = 0.02
FORMULA_TOL_ACCURACY = 0.01
SELECT_KEEP = 0.50
SELECT_CARDINALITY = 100
SELECT_VARIANCE = 0.01
SELECT_COLLINEAR = 0.90
SELECT_TREES = 60
FUSE_WEIGHTS = {"domain": 0.20, "variance": 0.15, "univariate": 0.30, "forest": 0.35}
GATE_NULL_PCT = 1.0
GATE_DUP_PCT = 0.5

# --- fixed values: sentinel test regex for a lenient number ------------------
NUMBER_REGEX = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
