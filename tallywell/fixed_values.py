"""Values that results depend on: domains, limits, patterns, word lists and the category tree.

Every regular expression here is written in the common subset of Java and RE2, so a
DuckDB oracle can use the very same text. ``\\b`` after a digit is spelled ``END`` because
Java counts accented letters as word characters and the original dialect does not.
"""

# ---- fixed values: domains -------------------------------------------------------------
ACCOUNT_TYPES = ["checking", "savings", "cash", "credit_card", "credit", "investment", "crypto"]
TRANSACTION_TYPES = ["expense", "income", "transfer"]
SPENDING_NATURES = ["none", "want", "need", "must"]
PLANS = ["free", "pro"]
SUBSCRIPTION_STATUSES = ["active", "canceled", "past_due"]
RULE_TYPES = ["general", "account_detection", "transfer"]
CONDITION_LOGICS = ["and", "or"]
RECONCILIATION_STATUSES = ["pending", "in_progress", "completed"]
IMPORT_STATUSES = ["pending", "in_progress", "completed", "failed"]

# ---- fixed values: limits and times ----------------------------------------------------
FREE_AI_PARSES_LIMIT = 15
FREE_TRANSACTIONS_LIMIT = 50
FREE_ACCOUNTS_LIMIT = 4
FREE_RULES_LIMIT = 5
FREE_CATEGORIES_LIMIT = 15
CACHE_TTL_SECONDS = 86_400
CACHE_KEY_PREFIX = "gemini:"
RETENTION_MONTHS = 12
LOCAL_ZONE = "America/Bogota"

# ---- fixed values: patterns ------------------------------------------------------------
END = r"(?:[^0-9A-Za-z_]|$)"
WIDE_SPACE = (
    r"[\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
)

# A ten-digit phone: the first pattern that matches wins.
PHONE_PATTERNS = [
    r"\*(\d{10})" + END,
    r"(?i)cuenta\s*\*?(\d{10})" + END,
    r"a\s+(\d{10})" + END,
    r"(?i)al?\s+\*?(\d{10})" + END,
]
# The last four digits of the account money leaves from.
ORIGIN_ACCOUNT_PATTERNS = [
    r"(?i)desde\s+tu\s+cuenta\s+(\d{4})" + END,
    r"(?i)cuenta\s+(\d{4})\s+a\s+la",
    r"(?i)\*(\d{4})\s*,?\s*el\s+\d",
]
TRANSFER_KEYWORDS = [
    "transferiste",
    "enviaste",
    "transferencia",
    "envío a",
    "envio a",
    "transfer to",
    "sent to",
]
# Where the bank sentence starts inside an e-mail body.
EMAIL_PATTERNS = [
    r"(?i)Bancolombia:.*?(?:\$|COP)?[\d,.]+.*?en.*?",
    r"(?i)Compraste.*?(?:\$|COP)?[\d,.]+.*?en.*?con tu",
    r"(?i)Retiraste.*?(?:\$|COP)?[\d,.]+.*?en",
    r"(?i)Pagaste.*?(?:\$|COP)?[\d,.]+.*?en",
]
EMAIL_GATE = "bancolombia"
EMAIL_EXCERPT_CHARS = 200

# ---- fixed values: skip reasons and the phrases (accents folded) that tell them ---------
SKIP_PHRASES = [
    ("spending_summary", ["tus gastos entre", "tus gastos cambiaron"]),
    ("balance_inquiry", ["consulta de saldo", "saldo disponible"]),
    ("otp_code", ["clave dinamica", "codigo de verificacion"]),
    ("promotional", ["activa tu tarjeta", "solicita tu credito"]),
    (
        "informational",
        ["cuenta ha sido bloqueada", "actualizamos tus datos", "extracto esta disponible"],
    ),
]

# A reminder opens the text.
REMINDER = r"^(?:[a-z ]+: *)?recuerda "

# The same reasons with the amount or code in the sentence: words of which one must occur, and the pattern.
SKIP_PATTERNS = {
    "balance_inquiry": (["saldo"], r"\b(?:tu|su|el) saldo(?: [a-z]+){0,4} es\b"),
    "otp_code": (
        ["codigo", "clave", "token", "otp"],
        r"\b(?:tu|su|el) (?:codigo|clave|token)(?: [a-z]+){0,4}(?: es:?|:) *\d"
        r"|\b(?:codigo|clave) otp\b|\botp(?: es:?|:)|\bcodigo de (?:seguridad|acceso)\b",
    ),
    "spending_summary": (["gasta"], r"\b(?:gastaste|has gastado)\b(?:[^.\n]|\.\d)*\b(?:este|el|ultimo|esta|la|ultima) (?:mes|ano|semana)\b"),
}

# What opens as a summary is one, whatever payments it lists.
SUMMARY = r"^(?:[a-z ]+: *)?resumen(?: *:| de (?:tus )?gastos| del? (?:mes|la semana|ano)| mensual| semanal)"

# A purchase, payment, withdrawal, transfer or receipt with its amount is a transaction whatever else the text says: a
# verb of the owner's, a receipt, or a noun that opens the text.
MOVE_NOUNS = r"(?:compra|pago|retiro|avance|transferencia|consignacion|abono|deposito|giro)"
AMOUNT_FOLLOWS = r" +(?:(?:por|de) +)?(?:(?:un )?valor de +)?(?:(?:\$|cop) *)?\d"
DONE_WITH_AMOUNT = (
    r"\b(?:compraste|pagaste|retiraste|transferiste|enviaste|consignaste|depositaste"
    r"|(?:realizaste|hiciste) una? " + MOVE_NOUNS + r")\b"
    r"(?: +(?:por +)?| +[^.\n$]*(?:\$|\bcop) *|[^.\n$]*\$ *)\d"
    r"|\b(?:recibiste|te (?:enviaron|consignaron|transfirieron|depositaron|abonaron|pagaron))"
    r"(?: una? " + MOVE_NOUNS + r")?" + AMOUNT_FOLLOWS + r"|^(?:[a-z ]+: *)?(?:[a-z ]*\binforma:? (?:que )?)?(?:una? )?" + MOVE_NOUNS
    + r"(?: (?:aprobad[ao]|exitos[ao]|realizad[ao]|recibid[ao]))?" + AMOUNT_FOLLOWS
)

# ---- fixed values: merchant words by category ------------------------------------------
MERCHANT_WORDS = {
    "bar-cafe": ["juan valdez", "starbucks", "oma"],
    "restaurant": ["rappi", "uber eats", "domicilios", "mcdonald's", "kfc", "crepes"],
    "groceries": ["exito", "carrefour", "jumbo", "ara", "d1"],
    "drugstore": ["farmatodo", "cruz verde"],
    "electronics": ["apple", "samsung", "xiaomi", "falabella"],
    "home-garden": ["home center", "sodimac"],
    "utilities": ["epm", "codensa", "eaab"],
    "taxi": ["uber", "didi", "cabify", "beat", "indriver", "taxi"],
    "public-transport": ["metro", "transmilenio", "sitp", "bus"],
    "fuel": ["terpel", "mobil", "esso"],
    "holiday": ["airbnb"],
    "streaming": ["netflix", "spotify", "disney+", "prime video", "hbo", "youtube premium"],
    "education": ["udemy", "platzi", "coursera"],
    "culture-events": ["cinemark", "procinal"],
    "fitness": ["gym", "smartfit", "bodytech"],
    "postal": ["servientrega"],
    "software": ["steam", "codashop", "google play", "apple store"],
    "phone": ["claro", "movistar", "tigo", "wom"],
}
# Plain words of the worked examples; they set a category but add no confidence.
PLAIN_WORDS = {"restaurant": ["almuerzo", "lunch"], "groceries": ["pan"]}

# ---- fixed values: old category slugs and what replaced them ---------------------------
RENAMED_SLUGS = {
    "missing": "uncategorized",
    "leisure": "gaming-hobbies",
    "collections": "art-collectibles",
    "vehicles-chattels": "vehicle-investments",
    "streaming": "subscriptions",
}

# ---- fixed values: calendar words (accents folded) -------------------------------------
MONTH_WORDS = [
    "enero", "febrero", "marzo", "abril", "mayo", "junio",
    "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
]
WEEKDAY_WORDS = ["lunes", "martes", "miercoles", "jueves", "viernes", "sabado", "domingo"]

# ---- fixed values: statement import ----------------------------------------------------
STATEMENT_CATEGORIES = {
    "Food & Drink": "food",
    "Restaurants": "food",
    "Groceries": "food",
    "Transport": "transportation",
    "Shopping": "shopping",
    "Entertainment": "entertainment",
    "Health": "health",
    "Bills & Utilities": "utilities",
    "Education": "education",
    "Home": "home",
    "Rent": "home",
    "Salary": "salary",
    "Fitness": "health",
    "Travel": "other",
}

# ---- fixed values: sentences the results contain ----------------------------------------
TRANSFER_DIGEST_HEAD = 'TRANSFERS: Messages with "Transferiste"/"Enviaste" are transfers. Known phones: '
TRANSFER_DIGEST_TAIL = '. Unknown phones→category:"missing".'
RULE_DIGEST_HEAD = (
    "AUTOMATION RULES (apply these when conditions match, they override default categorization):\n"
)
RULE_DIGEST_TAIL = (
    "\nIf a rule matches, use the specified values. "
    "These rules are deterministic overrides from the user."
)
ACCOUNT_HINT = ['ACCOUNT CONTEXT: This message is from account "', '" (id: ', ")."]
NOTE_NO_PHONE = "Transfer - no matching phone found"
NOTE_NO_RULE = ["Transfer to ", " - no matching rule"]
NOTE_OUTGOING = "Internal transfer to "
NOTE_INCOMING = "Internal transfer from account ending in "
TEXT_OUTGOING = "Transfer to "
TEXT_INCOMING = "Transfer from "
INCOMING_FROM_UNNAMED = "Bancolombia"
REJECT_AMOUNT = "Invalid amount"
REJECT_DESCRIPTION = "Missing description"
REJECT_CATEGORY = "Missing category"
REJECT_TEXT = "Missing text"
CHAT_SOURCE = "telegram"  # fixed value of the stored source of chat messages
DEFAULT_SKIP_REASON = "not_transaction"
PARSE_LIMIT_REACHED = "PARSE_LIMIT_REACHED"

# ---- fixed values: defaults of generated rules -------------------------------------------
RULE_DEFAULTS = {"name": "Unnamed Rule", "rule_type": "general", "condition_logic": "or", "conditions": "{}", "actions": "{}"}
DEFAULT_PRIORITY = 50
ACCOUNT_RULE_PRIORITY = 100

# ---- fixed values: default category tree -----------------------------------------------
# parent slug, parent name, type, nature, then children as (slug, name, nature)
CATEGORY_TREE = [
    ("food-drinks", "Food & Drinks", "expense", "need", [
        ("bar-cafe", "Bar, Cafe", "need"),
        ("restaurant", "Restaurant, Fast-food", "need"),
        ("groceries", "Groceries", "need"),
        ("delivery", "Delivery", "want"),
    ]),
    ("shopping", "Shopping", "expense", "want", [
        ("drugstore", "Drug-store, Chemist", "need"),
        ("gaming-hobbies", "Gaming & Hobbies", "want"),
        ("stationery", "Stationery, Tools", "want"),
        ("gifts", "Gifts, Joy", "want"),
        ("electronics", "Electronics, Accessories", "want"),
        ("pets", "Pets, Animals", "need"),
        ("home-garden", "Home, Garden", "want"),
        ("kids", "Kids", "need"),
        ("health-beauty", "Health and Beauty", "want"),
        ("jewels", "Jewels, Accessories", "want"),
        ("clothes", "Clothes & Footwear", "want"),
    ]),
    ("housing", "Housing", "expense", "must", [
        ("property-insurance", "Property Insurance", "must"),
        ("maintenance", "Maintenance, Repairs", "must"),
        ("housing-services", "Services", "must"),
        ("utilities", "Energy, Utilities", "must"),
        ("mortgage", "Mortgage", "must"),
        ("rent", "Rent", "must"),
    ]),
    ("transportation", "Transportation", "expense", "need", [
        ("business-trips", "Business Trips", "need"),
        ("long-distance", "Long Distance", "need"),
        ("taxi", "Taxi", "need"),
        ("public-transport", "Public Transport", "need"),
    ]),
    ("vehicle", "Vehicle", "expense", "need", [
        ("leasing", "Leasing", "must"),
        ("vehicle-insurance", "Vehicle Insurance", "must"),
        ("vehicle-rentals", "Rentals", "want"),
        ("vehicle-maintenance", "Vehicle Maintenance", "need"),
        ("parking", "Parking", "need"),
        ("fuel", "Fuel", "need"),
    ]),
    ("entertainment", "Life & Entertainment", "expense", "want", [
        ("lottery", "Lottery, Gambling", "want"),
        ("alcohol-tobacco", "Alcohol, Tobacco", "want"),
        ("holiday", "Holiday, Trips, Hotels", "want"),
        ("subscriptions", "Subscriptions & Streaming", "want"),
        ("education", "Education, Development", "need"),
        ("hobbies", "Hobbies", "want"),
        ("life-events", "Life Events", "want"),
        ("culture-events", "Culture, Sport Events", "want"),
        ("fitness", "Active Sport, Fitness", "need"),
        ("wellness", "Wellness, Beauty", "want"),
        ("health-care", "Health Care, Doctor", "must"),
        ("personal-care", "Personal Care", "need"),
    ]),
    ("technology", "Technology & Internet", "expense", "need", [
        ("postal", "Postal Services", "need"),
        ("software", "Software, Apps, Games", "want"),
        ("internet", "Internet", "must"),
        ("phone", "Telephony, Mobile Phone", "must"),
        ("cloud-services", "Cloud Services", "want"),
    ]),
    ("financial", "Financial Expenses", "expense", "must", [
        ("child-support-expense", "Child Support", "must"),
        ("fees", "Charges, Fees", "must"),
        ("advisory", "Advisory", "want"),
        ("fines", "Fines", "must"),
        ("loans", "Loans, Interests", "must"),
        ("insurances", "Insurances", "must"),
        ("taxes", "Taxes", "must"),
        ("debt-payment", "Debt Payment", "must"),
    ]),
    ("investments", "Investments", "expense", "none", [
        ("art-collectibles", "Art & Collectibles", "none"),
        ("savings-category", "Savings", "none"),
        ("financial-investments", "Financial Investments", "none"),
        ("vehicle-investments", "Vehicle Investments", "none"),
        ("realty", "Realty", "none"),
    ]),
    ("income", "Income", "income", "none", [
        ("gifts-income", "Gifts (Income)", "none"),
        ("child-support-income", "Child Support (Income)", "none"),
        ("refunds", "Refunds", "none"),
        ("lottery-income", "Lottery, Gambling (Income)", "none"),
        ("checks", "Checks, Coupons", "none"),
        ("lending", "Lending, Renting", "none"),
        ("grants", "Dues & Grants", "none"),
        ("rental-income", "Rental Income", "none"),
        ("sale", "Sale", "none"),
        ("dividends", "Interests, Dividends", "none"),
        ("wage", "Wage, Invoices", "none"),
    ]),
    ("others", "Others", "expense", "none", [
        ("uncategorized", "Uncategorized", "none"),
        ("charity", "Charity, Gifts", "want"),
    ]),
    ("transfer", "Transfer", "transfer", "none", []),
]
