"""Fixed values of the ledger: vocabularies, markers and limits (values that results depend on)."""

DIRECTIONS = ("debit", "credit")
KINDS = ("merchant", "person", "bank_charge", "self_transfer", "unknown")
#: Kinds left out of spend rankings.
NOT_RANKED = ("bank_charge", "self_transfer", "unknown")
UNKNOWN = "UNKNOWN"
FEE, SELF = "__BANK_CHARGE__", "__SELF_TRANSFER__"
FEE_LABEL, SELF_LABEL = "BANK CHARGES", "SELF TRANSFER"

#: Narration that marks a bank's fee; matched at word boundaries.
FEE_MARKS = ["charges", "charge", "amc fee", "service fee", "gst on", "sms alert", "annual fee", "penalty", "min bal", "atm fee", "processing fee"]
#: Narration that marks a movement between own accounts.
SELF_MARKS = ["self transfer", "- self -", "/self/", "own account", "self a/c"]
#: Fields of a narration that are never a counterparty.
STOPWORDS = [
    "UPI", "NEFT", "IMPS", "RTGS", "FT", "P2A", "P2P", "INET", "OW", "IW", "INWD", "OUTW", "CLG", "TRF", "MISC", "ADJ",
    "REF", "SELF", "MOB", "NET", "ATM", "POS", "ACH", "ECS", "NACH", "CMS", "BY", "TO", "FROM", "CR", "DR",
    "SELF TRANSFER", "CHQ", "CASH", "TFR", "PAYMENT", "TRANSFER", "INB", "IMPS OW", "IMPS IW",
]
#: Words of commercial names.
CORPORATE = [
    "TECHNOLOGIES", "TECHNOLOGY", "SERVICES", "SOLUTIONS", "SYSTEMS", "ENTERPRISES", "INDUSTRIES", "RETAIL", "STORES",
    "STORE", "MART", "SUPERMARKET", "BAZAAR", "ELECTRONICS", "PHARMACY", "PHARMA", "HOSPITAL", "CLINIC", "MEDICAL",
    "DIGITAL", "POWER", "ENERGY", "TELECOM", "COMMUNICATIONS", "MOTORS", "TRAVELS", "TOURS", "AIRLINES", "HOTELS",
    "RESTAURANT", "FOODS", "BEVERAGES", "APPAREL", "FASHION", "JEWELLERS", "TRADERS", "AGENCIES", "DISTRIBUTORS",
    "CONSULTANCY", "CONSULTING", "CAPITAL", "FINANCE", "FINSERV", "INSURANCE", "BANK", "PAYMENTS", "COMMERCE", "ONLINE",
    "INTERNET", "SOFTWARE", "LABS", "FIT", "GYM", "SALON", "CAFE", "KITCHEN", "SELECTION", "COMPANY", "GROUP",
]
#: Legal forms at the end of a name.
LEGAL = [
    "PRIVATE LIMITED", "PVT LTD", "PVT. LTD.", "PVT LTD.", "P LTD", "LIMITED", "LTD", "LLP", "LLC", "INC", "CORP",
    "CORPORATION", "COMPANY", "CO", "AND CO", "INDIA", "INDIA PVT",
]
#: Legal or product names and the brand they belong to.
BRANDS = {
    "BUNDL TECHNOLOGIES": "SWIGGY",
    "SWIGGY INSTAMART": "SWIGGY",
    "SWIGGYIT": "SWIGGY",
    "ETERNAL": "ZOMATO",
    "ZOMATO MEDIA": "ZOMATO",
    "BLINK COMMERCE": "BLINKIT",
    "GROFERS INDIA": "BLINKIT",
    "AMAZON PAY": "AMAZON",
    "AMAZON SELLER SERVICES": "AMAZON",
    "AMZN": "AMAZON",
    "FLIPKART INTERNET": "FLIPKART",
    "UBER INDIA SYSTEMS": "UBER",
    "OLA CABS": "OLA",
    "ANI TECHNOLOGIES": "OLA",
}
ALIAS_VERSION = 1
#: Similarity from which names are one; names under this length only stand alone.
CLUSTER_FROM, CLUSTER_LENGTH = 92, 4
#: Days behind the watermark that an increment reads again.
LOOKBACK_DAYS = 7
PERSON_FROM, PERSON_WORDS = 3, 4
