"""Word lists, tables and limits that results depend on.

Names of household members and employers are placeholders; pass your own settings
where a function takes them.
"""

import re

AUTO = "Auto"

# --- fixed values: taxonomies -------------------------------------------------
CATEGORIES = (
    "Groceries", "Dining & Coffee", "Transportation", "Fuel", "Marketplace", "Shopping", "Subscriptions", "Utilities & Bills", "Housing", "Mortgage & Loans",
    "Salary & EI", "Health & Pharmacy", "Travel", "Home", "Kids & Family", "Entertainment", "Business", "Education", "Gifts & Charity", "Fees", "Internal Transfer",
    "Income", "Refund", "Other",
)
NECESSITIES = ("Auto", "Essential", "Fixed Bills", "Discretionary", "Child & Family", "Business", "Savings & Transfers", "Income", "Refund")
BENEFICIARIES = ("Auto", "Shared", "Child", "MemberA", "MemberB")

# --- fixed values: category rules, in order: category, necessity, beneficiary, keywords ---
CATEGORY_RULES = (
    ("Groceries", "Essential", "Shared", (
        "farm boy", "sobeys", "loblaws", "costco", "heeva fine foods", "mellat fine foods", "freshco", "instacart", "act*town", "vicentina", "t&t",
    )),
    ("Dining & Coffee", "Discretionary", "Auto", ("starbucks", "mcdonald", "tim hortons", "panera", "pizza", "dominos", "ritual", "what a bagel", "forno cultura")),
    ("Transportation", "Essential", "Auto", ("uber", "presto", "407etr", "parking", "bike share")),
    ("Fuel", "Essential", "Auto", ("esso", "shell", "petro")),
    ("Marketplace", "Discretionary", "Auto", ("amzn", "amazon")),
    ("Shopping", "Discretionary", "Auto", ("roots", "marshalls", "winners", "zwilling", "sporting life", "long & mcquade", "staples", "hm", "geox", "arcteryx")),
    ("Health & Pharmacy", "Essential", "Shared", ("shoppers drug mart",)),
    ("Utilities & Bills", "Fixed Bills", "Shared", ("videotron", "paymentus", "reliance", "hydro", "corporation of", "city of")),
    ("Mortgage & Loans", "Fixed Bills", "Shared", ("online banking loan payment", "mortgage payment", "loan payment", "loan interest", "term loan", "mortgage")),
    ("Housing", "Fixed Bills", "Shared", ("rent", "property tax")),
    ("Home", "Essential", "Shared", ("home depot", "tree valley garden")),
    ("Travel", "Discretionary", "Shared", ("flighthub", "emirates", "hotel", "airbnb", "admtoronto")),
    ("Kids & Family", "Child & Family", "Child", ("tiger kicks", "space center", "wonderland", "souris mini", "childrens", "brain")),
    ("Subscriptions", "Discretionary", "Shared", ("netflix",)),
    ("Subscriptions", "Discretionary", "Auto", ("spotify", "audible")),
    ("Subscriptions", "Discretionary", "Shared", ("google one",)),
    ("Subscriptions", "Discretionary", "Auto", ("apple.com/bill",)),
    ("Business", "Business", "MemberB", ("openai", "ownr", "minute book", "envoy business")),
    ("Fees", "Fixed Bills", "Auto", ("service fee", "annual fee")),
    ("Groceries", "Essential", "Shared", ("walmart", "metro", "food basics", "no frills")),
    ("Shopping", "Discretionary", "Auto", ("dollarama",)),
    ("Dining & Coffee", "Discretionary", "Auto", ("lcbo", "beer store", "doordash", "skip the dishes", "uber eats")),
    ("Entertainment", "Discretionary", "Auto", ("cineplex",)),
    ("Home", "Essential", "Shared", ("canadian tire",)),
    ("Health & Pharmacy", "Essential", "Shared", ("rexall",)),
    ("Home", "Essential", "Shared", ("pet valu",)),
    ("Shopping", "Discretionary", "Auto", ("indigo", "sport chek")),
    ("Business", "Business", "MemberB", ("mnp",)),
)

# --- fixed values: merchant aliases, in order: label: strings contained ------------
MERCHANT_ALIASES = (
    ("Costco", ("costco wholesale", "costco gas", "costco business", "costco ca", "costco")),
    ("Amazon", ("amzn mktp", "amazon marketplace", "amazon.com", "amazon.ca", "amazon pay", "amazon web", "amazon", "amzn")),
    ("Walmart", ("walmart supercenter", "walmart")),
    ("Uber", ("uber eats", "uber trip", "ubertrip", "uber canada", "uber ca", "uber*")),
    ("Lyft", ("lyft",)),
    ("DoorDash", ("doordash", "dd *")),
    ("Starbucks", ("starbucks",)),
    ("McDonald's", ('mcdonald',)),
    ("Tim Hortons", ("tim hortons", "tim horton")),
    ("Metro", ("metro #", "metro inc", "metro ontario")),
    ("Loblaws", ("loblaws", "real canadian superstore", "superstore")),
    ("Sobeys", ("sobeys",)),
    ("Farm Boy", ("farm boy",)),
    ("Instacart", ("instacart",)),
    ("Shoppers Drug Mart", ("shoppers drug mart", "shoppers dr")),
    ("Shell", ("shell ", "shell#")),
    ("Petro-Canada", ("petro-canada", "petro canada")),
    ("Esso", ("esso ",)),
    ("Canadian Tire", ("canadian tire",)),
    ("Home Depot", ("home depot", "home dep")),
    ("Winners", ("winners",)),
    ("Marshalls", ("marshalls",)),
    ("Sport Chek", ("sport chek",)),
    ("Best Buy", ("best buy",)),
    ("Netflix", ("netflix",)),
    ("Spotify", ("spotify",)),
    ("Apple", ("apple.com/bill", "apple store")),
    ("Google", ("google one",)),
    ("PayPal", ("paypal *", "paypal")),
)

# --- fixed values: gateway prefixes -----------------
GATEWAY_PREFIXES = (
    "purchase ", "point of sale ", "pos ", "debit ", "visa ", "mastercard ", "mc ", "contactless ", "tap ", "recurring ", "preauthorized ", "pre-authorized ",
    "e-commerce ", "ecommerce ", "online payment ", "sq *", "sq*", "tst*", "sp *", "sp*",
)

# --- fixed values: words that decide how money flows ---
RECEIPT_MARKERS = (
    "e-transfer received", "receive e-transfer", "receive an e-transfer", "receive an interac", "etransfer received", "autodeposit", "auto-deposit", "automatic deposit",
    "deposit from",
)
TRANSFER_WORDS = (
    "payment - thank you", "paiement - merci", "paiement - thank you", "credit card payment", "cc payment", "visa payment", "mc payment", "bill payment",
    "online banking payment", "internet banking payment", "mobile banking payment", "pre-authorized payment", "preauthorized payment", "paymentus", "e-transfer",
    "etransfer", "interac e-transfer", "interac e transfer", "send e-transfer", "receive e-transfer", "e transfer", "online transfer", "funds transfer", "bank transfer",
    "account transfer", "transfer to", "transfer from", "tfr ", " tfr", "wire transfer", "investment transfer", "autopay", "automatic payment",
)
REFUND_WORDS = ("refund", "reversal", "return", "credit voucher")
PAY_WORDS = ("payroll", "salary", "direct deposit", "pay dep", "pay deposit", "pay cheque", "paycheck", "ei canada", "employment insurance")
OTHER_INCOME_WORDS = ("cashback", "cash back", "rebate", "interest paid", "dividend")
FEE_WORDS = ("interest charge", "annual fee", "late fee", "service fee")
RETAIL_DEBIT_MARKERS = (
    "interac purchase", "interac purchase refund", "interac refund", "contactless interac", "interac flash", "visa debit purchase", "debit visa", "debit purchase",
    "visa purchase", "mastercard purchase",
)
INTERNAL_PHRASES = (
    "e-transfer", "etransfer", "interac e-transfer", "interac e - transfer", "virement interac", "bill payment", "credit card payment", "online banking payment",
    "pre-authorized payment", "preauthorized payment", "payment - thank", "paiement", "autopay", "automatic payment", "funds transfer", "account transfer",
    "online transfer", "wire transfer", "tfr ", " tfr", "withdrawal", "deposit", "savings", "chequing", "checking", "investment", "visa payment", "mc payment",
    "line of credit", "loc payment",
)
TIMING_HINTS = (
    "payment", "transfer", "deposit", "withdrawal", "savings", "chequing", "checking", "investment", "visa", "mastercard", "mortgage", "loan", "credit bal", "pre-auth",
    "preauth",
)

# --- fixed values: ledgers of true cash ------------------------------------------------
RETAIL_CREDIT_WORDS = (
    "refund", "reversal", "interac purchase refund", "contactless interac refund", "interac refund", "purchase refund", "credit voucher", "cash back", "cashback",
    "returned",
)
CASH_OUT_WORDS = (
    "atm withdrawal", "withdrawal - atm", "withdrawal atm", "atm - ", "atm -", "cash withdrawal", "cash wdl", "wdl atm", "cash advance", "cash out", "branch withdrawal",
    "debit cash",
)
PURCHASE_OR_BILL_WORDS = (
    "interac purchase", "contactless interac", "pre-authorized", "preauthorized", "bill payment", "online banking payment", "credit card payment", "visa payment",
    "mc payment", "payment - thank",
)
MORTGAGE_PATTERN = r"mortgage|mcap|\bmortg\b"

# --- fixed values: what a category is needed for (others: Discretionary) -----------
NECESSITY_OF = (
    ("Essential", ("Groceries", "Transportation", "Fuel", "Health & Pharmacy", "Home", "Education")),
    ("Fixed Bills", ("Utilities & Bills", "Housing", "Mortgage & Loans")),
    ("Income", ("Salary & EI", "Income")),
    ("Child & Family", ("Kids & Family",)),
    ("Business", ("Business",)),
)
SHARED_CATEGORIES = ("Groceries", "Utilities & Bills", "Housing", "Mortgage & Loans", "Salary & EI", "Home", "Travel", "Health & Pharmacy")

# --- fixed values: spending groups of the batch statistics, in order: group: words ---
SPEND_GROUPS = (
    ("Travel & Vacation", ("dcl reservations", "flighthub", "avion*air", "fallsview", "wc*fallsview", "hotel", "air canada", "airbnb", "expedia")),
    ("Kids Education & Activities", (
        "brain power", "brainpowers", "kids den", "steamoji", "strategy games", "spelling bee", "math kangaroo", "chesskid", "inspire learner", "saliwan fight club",
        "tiger kicks", "eventbrite/richmondhil", "act*townrichmondhill", "townrichmondhill",
    )),
    ("Groceries", (
        "costco wholesale", "costco wholesal", "www costco", "walmart", "sobeys", "farm boy", "loblaws", "longo", "freshco", "freshpro", "coppa", "heeva", "mellat",
        "persian meat", "super arzon", "halal fine", "greek market", "natures emporium", "marche", "vicentina", "t&t",
    )),
    ("Dining & Coffee", (
        "starbucks", "tim hortons", "mcdonald", "stacked pancake", "state & main", "niku japanese", "donerlicious", "haida sandwich", "thai express", "a&w",
        "yogen fruz", "bread & roses", "yazdi pastry", "eisenbergs", "pur & simple", "onroute", "what a bagel", "mr. pretzels", "uncle tetsu", "second cup",
        "ritual-the bagel", "ritual-impact kitchen", "aashland", "lcbo",
    )),
    ("Fuel & Auto", ("shell", "esso", "petro-canada", "circle k", "parking", "407etr", "presto", "uber")),
    ("Utilities & Insurance", ("bell mobility", "reliance home", "belair", "ass/ins", "insurance", "hydro", "paymentus", "videotron")),
    ("Shopping & Personal", (
        "sephora", "lululemon", "browns shoes", "softmoc", "geox", "skechers", "gap.com", "jack jones", "calvin klein", "b r factory", "columbia sportswear", "arcteryx",
        "roots", "marshalls", "homesense", "hm ca", "long & mcquade", "finch gift shop", "*rfbt", "dollarama", "souris mini", "upper canada iso",
    )),
    ("Home, Pets & Household", ("home depot", "canadian tire", "sherwin-williams", "canyon hill animal", "petsmart", "pet valu", "ikea")),
    ("Health & Pharmacy", ("shoppers drug mart", "sdm ", "jean coutu", "astra pharmacy", "southlake regional", "rexall")),
    ("Entertainment", (
        "ticketmaster", "trapped escape", "merlin entertainments", "legoland", "funvilla", "imagine cinemas", "cineplex", "the jump city", "musee residences",
        "ldc toronto", "fv indoor waterpark", "wonderland foods", "wonderland merchand", "space center", "meridian arts centre",
    )),
    ("Subscriptions & Digital", ("apple.com/bill", "paddle.net", "netflix", "spotify", "audible", "google", "openai", "facebooktec")),
    ("Marketplace / Amazon", ("amazon", "amzn")),
    ("Government, IDs & Fees", ("service canada", "online police records", "annual renewal", "service fee", "annual fee")),
)
#: Looked at before the groups, in order.
SPEND_FIRST = (
    ("Taxes", ("cra-rev", "tax")),
    ("Mortgage, Loans & Debt", ("mortgage payment", "loan payment", "term loan", "loan interest")),
    ("Utilities & Insurance", ("insurance", "belair", "rbcins", "all life")),
    ("Utilities & Insurance", ("bill payment", "utility bill", "misc payment alectra", "enbridge")),
    ("Bank Fees & Interest", ("monthly fee", "nsf item fee", "overdraft interest")),
    ("Cash Withdrawal", ("atm withdrawal",)),
)
SENT_TRANSFER = "e-transfer sent"
LESSON_WORDS = ("piano", "stem project", "soccer", "yip music", "tutor", "music")
OWN_TRANSFER_MARKERS = (
    "online banking transfer", "online transfer to deposit account", "credit card payment", "payment - thank you", "visa payment", "mc payment", "mastercard payment",
    "online transfer sent -",
)
INTERNAL_INFLOW_MARKERS = ("online banking transfer", "online transfer received", "online transfer to deposit account")
INCOME_SOURCES = (
    ("Other Payroll", ("payroll deposit",)),
    ("EI Canada", ("ei canada",)),
    ("Refunds & Rebates", ("refund", "rebate", "item returned")),
    ("CRA / Tax", ("cra-rev",)),
    ("Benefits / Medavie", ("medavie",)),
    ("Interest", ("deposit interest",)),
    ("External E-Transfer", ("e-transfer", "autodeposit")),
)

# --- fixed values: limits ------------------------------------------------------------
PAIR_DAYS, PAIR_CENTS, SECOND_PASS_LEAST, RECONCILE_CENTS = 7, 0.01, 5.0, 0.02
#: Lines of capitals on statements that are no names.
NOT_NAMES = (
    "SIGNATURE RBC REWARDS VISA", "CONTACT US", "IMPORTANT INFORMATION", "CALCULATING YOUR BALANCE", "RBC ROYAL BANK", "CREDIT CARD PAYMENT CENTRE", "PAYMENTS & INTEREST RATES",
    "AVION POINTS", "STAY SAFE FROM FRAUD & SCAMS",
)
#: How many accounts of a kind should have a statement in a month, where the settings say nothing else.
EXPECTED_ACCOUNTS = {"chequing": 4, "visa": 1, "mastercard": 1}
LEDGER_CAP, RECENT_CAP, UNMATCHED_CAP, REVIEW_CAP, OTHER_CAP, MATCHED_CAP, PAGE_CAP = 2500, 80, 25, 100, 25, 35, 200


# --- fixed values: bank statements: wordings that decide a row's direction, the first that is found; 0: only the balance tells ---
BANK_SIGNS = (
    (("loan interest",), -1), (("interest charge",), -1), (("online banking transfer",), 0), (("online transfer to deposit",), -1), (("cra-rev",), 1), (("item returned", "nsf"), 1),
    (("deposit",), 1), (("payroll",), 1), (("ei canada",), 1), (("employment insurance",), 1), (("refund",), 1), (("rebate",), 1), (("reward",), 1), (("e-transfer received",), 1), (("transfer received",), 1),
)
#: Rows whose printed amount holds even where it differs from the change of the balance.
BANK_OWN_AMOUNT = ("online transfer to deposit",)
# --- fixed values: bank statements: how lines begin ---
BANK_NEW_ROW = re.compile(
    r"^(Online\s+Banking|Online\s+Transfer|Mortgage\s+payment|Interac|Contactless|Payroll|ATM|Loan\s+payment|Partial\s|Monthly|e-Transfer\s+sent|e-Transfer\s+received|e-Transfer\s+Request|"
    r"e-Transfer\s+-|Misc\s+Payment|Utility\s+Bill|Insurance\b|Term\s+Loan|Bill\s+Payment|Item\s+returned|NSF\s+item|CRA-|WWW\.)", re.I,
)
BANK_FOLLOW_ON = re.compile(r"^(Loan\s+interest|Interest\s+payment|Principal\b)", re.I)
BANK_SHARES_ANY = re.compile(r"^Mortgage\s+payment\b", re.I)
BANK_SHARES_ONLINE = re.compile(r"^(Interac|Contactless)", re.I)
BANK_ONLINE = re.compile(r"^Online\s+Banking\b", re.I)
BANK_ENDS = re.compile(r"^(opening balance|closing balance)|\*\*account switch\*\*", re.I)
BANK_BOILERPLATE = re.compile(
    r"^(?:\d+\s+of\s+\d+|Page\s+\d+|RBPDA\d|RBPDA\s|Your\s+RBC\s+personal|account\s+statement|From\s+[A-Za-z]+\s+\d|Important\s+information|Never\s+share|Protect\s+your\s+PIN|Here\s+are\s+four|\*[0-9A-Z]{6,}|Royal\s+Bank\s+of\s+Canada|C\.P\.\s+\d+|Montreal\s+QC|"
    r"https?://|Please\s+check|Please\s+retain|Stay\s+Informed|Details\s+of\s+your\s+account\s+activity\s*-\s*continued)", re.I,
)


def words(entries: tuple[str, ...]) -> list[str]:
    """The entries of a list."""
    return list(entries)


def lines(table: tuple[tuple[str, tuple[str, ...]], ...]) -> list[tuple[str, list[str]]]:
    """The (head, entries) of each row of a table."""
    return [(head, list(entries)) for head, entries in table]


def category_rules() -> list[dict[str, str]]:
    out = []
    for category, necessity, beneficiary, keywords in CATEGORY_RULES:
        out += [{"keyword": k, "category": category, "necessity": necessity, "beneficiary": beneficiary} for k in keywords]
    return out


def merchant_aliases() -> list[tuple[str, str]]:
    return [(needle, label) for label, needles in lines(MERCHANT_ALIASES) for needle in needles]
