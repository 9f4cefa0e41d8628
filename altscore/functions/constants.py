"""Fixed values that must equal the scoring rules being reproduced.

FIXED VALUES — category lists, thresholds, weights and limits.  They are
stated here once, in natural order, and every operator reads them from here.
"""

# --- FIXED VALUES: transaction sources -------------------------------------
INCOME_SOURCES = ["UPI", "Bank Transfer", "Mandi Sale", "Customer Payment",
                  "Government Subsidy", "Rent Income"]
EXPENSE_SOURCES = ["Electricity Bill", "Mobile Recharge", "Grocery", "Medical", "Fuel",
                   "School Fees", "Loan EMI", "Insurance"]

# Essential expense sources (expense ratio) and the wider set that also
# counts groceries as non-discretionary.
ESSENTIAL5 = ["Electricity Bill", "Medical", "School Fees", "Insurance", "Loan EMI"]
ESSENTIAL6 = ["Electricity Bill", "Medical", "School Fees", "Insurance", "Loan EMI", "Grocery"]
# Bills used by the bill-payment regularity feature.
BILLS2 = ["Electricity Bill", "Mobile Recharge"]
# Bills used by the bill-timeliness discipline feature.
BILLS3 = ["Electricity Bill", "Mobile Recharge", "Insurance"]
EMI_SOURCE = "Loan EMI"

# Case-insensitive message patterns.
FAILED_PATTERN = "fail|bounce|reject"
CARD_PATTERN = "credit card|card payment"

# --- FIXED VALUES: decisions and scores -------------------------------------
DECISION_THRESHOLD = 0.6          # approve iff score > 0.6 (strict)
DECISIONS = ["approve", "reject", "manual_review"]
APPROVAL_SCORE = 50.0             # generated label: approved iff score >= 50
DEFAULT_SCORE = 40.0              # generated label: default iff approved and score < 40

# Category weights of the profitability score (income, expense, social,
# discipline, behaviour) and of the feature groups (location has weight 0).
SCORE_WEIGHTS = {"income": 0.40, "expense": 0.25, "social": 0.15,
                 "discipline": 0.10, "behavioral": 0.10}
GROUP_WEIGHTS = {"income": 0.40, "expense": 0.25, "social": 0.15,
                 "discipline": 0.10, "behavioral": 0.10, "location": 0.0}

# Confidence: 0.7 x share of non-zero features, bounded to [0.30, 0.95];
# x 0.8 when any feature is more than 3 standard deviations out.
CONFIDENCE_SCALE = 0.7
CONFIDENCE_MIN = 0.30
CONFIDENCE_MAX = 0.95
OUTLIER_PENALTY = 0.8
OUTLIER_Z = 3.0

# Business metric money (INR): profit per true positive / true negative,
# cost per false positive / false negative.
TP_PROFIT = 5000
TN_SAVING = 100
FP_COST = 50000
FN_COST = 1000

# --- FIXED VALUES: validation limits ----------------------------------------
TXN_TYPES = ["credit", "debit"]
GENDERS = ["male", "female", "other"]
OCCUPATIONS = ["farmer", "shopkeeper", "daily_wage", "self_employed", "salaried"]
LOCATION_TYPES = ["rural", "semi_urban", "urban"]
APPLICATION_STATUSES = ["submitted", "processing", "approved", "rejected", "disbursed"]
PERIOD_TYPES = ["hourly", "daily", "weekly"]
MAX_MESSAGE_LEN = 500
MAX_PURPOSE_LEN = 200
MIN_TXNS, MAX_TXNS = 10, 200
MAX_LOAN_TO_INCOME = 24
API_LOAN_MIN, API_LOAN_MAX = 1000, 500000
API_MAX_TXNS = 10000
BATCH_MIN, BATCH_MAX = 1, 100

# --- FIXED VALUES: request log ----------------------------------------------
RATE_LIMIT_REQUESTS = 100
RATE_LIMIT_WINDOW_S = 900
LATENCY_KEEP_LAST = 10000
SCORE_BUCKET_BOUNDS = [0, 20, 40, 60, 80, 100]

# --- FIXED VALUES: GBT defaults ---------------------------------------------
GBT_DEFAULTS = {"maxIter": 500, "maxDepth": 5, "stepSize": 0.05,
                "minInstancesPerNode": 20, "subsamplingRate": 0.8,
                "featureSubsetStrategy": "0.8", "seed": 42}
