"""The merchant catalogue and the fixed vocabularies of descriptors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Id, display name, MCC, aliases, tags of well-known merchants.
CATALOGUE = [
    ("swiggy", "Swiggy", 5814, ["SWIGGY", "SWIGGY LIMITED", "BUNDL TECHNOLOGIES"], ["swiggy", "food_delivery"]),
    ("zomato", "Zomato", 5814, ["ZOMATO", "ZOMATO LTD", "ETERNAL"], ["zomato", "food_delivery"]),
    ("dominos", "Domino's Pizza", 5814, ["DOMINOS", "DOMINOS PIZZA", "JUBILANT FOODWORKS"], ["food_delivery"]),
    ("starbucks", "Starbucks", 5814, ["STARBUCKS", "TATA STARBUCKS"], ["dining"]),
    ("bigbasket", "BigBasket", 5411, ["BIGBASKET", "BIG BASKET", "INNOVATIVE RETAIL"], ["grocery"]),
    ("blinkit", "Blinkit", 5411, ["BLINKIT", "GROFERS"], ["grocery"]),
    ("zepto", "Zepto", 5411, ["ZEPTO", "ZEPTONOW"], ["grocery"]),
    ("dmart", "DMart", 5411, ["DMART", "AVENUE SUPERMARTS"], ["grocery"]),
    ("amazon", "Amazon", 5399, ["AMAZON", "AMAZON PAY", "AMAZON SELLER", "AMAZON RETAIL"], ["amazon", "marketplace"]),
    ("flipkart", "Flipkart", 5399, ["FLIPKART", "FKRT", "FLIPKART INTERNET"], ["marketplace"]),
    ("myntra", "Myntra", 5691, ["MYNTRA", "MYNTRA DESIGNS"], ["apparel"]),
    ("nykaa", "Nykaa", 5977, ["NYKAA", "FSN ECOMMERCE"], ["beauty"]),
    ("uber", "Uber", 4121, ["UBER", "UBER INDIA", "UBER RIDES"], ["uber", "transport"]),
    ("ola", "Ola", 4121, ["OLA", "OLACABS", "ANI TECHNOLOGIES"], ["ola", "transport"]),
    ("rapido", "Rapido", 4121, ["RAPIDO", "ROPPEN TRANSPORTATION"], ["transport"]),
    ("irctc", "IRCTC", 4112, ["IRCTC", "IRCTC RAIL", "INDIAN RAILWAY"], ["rail", "transport"]),
    ("namma_yatri", "Namma Yatri", 4121, ["NAMMA YATRI", "NAMMAYATRI", "JUSPAY"], ["transport"]),
    ("jiohotstar", "JioHotstar", 4899, ["JIOHOTSTAR", "HOTSTAR", "DISNEY HOTSTAR", "HOTSTARONL"], ["streaming", "subscription"]),
    ("netflix", "Netflix", 4899, ["NETFLIX", "NETFLIX ENTERTAINMENT"], ["streaming", "subscription"]),
    ("spotify", "Spotify", 5735, ["SPOTIFY", "SPOTIFY INDIA"], ["streaming", "subscription"]),
    ("jio", "Jio", 4814, ["JIO", "RELIANCE JIO", "JIO RECHARGE", "JIOPAY"], ["telecom", "utility"]),
    ("airtel", "Airtel", 4814, ["AIRTEL", "BHARTI AIRTEL"], ["telecom", "utility"]),
    ("bookmyshow", "BookMyShow", 7832, ["BOOKMYSHOW", "BIGTREE ENTERTAINMENT", "BMS"], ["entertainment"]),
    ("pvr", "PVR INOX", 7832, ["PVR", "INOX", "PVR INOX"], ["entertainment"]),
    ("makemytrip", "MakeMyTrip", 4722, ["MAKEMYTRIP", "MMT", "MAKE MY TRIP"], ["travel"]),
    ("indigo", "IndiGo", 4511, ["INDIGO", "INTERGLOBE AVIATION", "GOINDIGO"], ["airline", "travel"]),
    ("pharmeasy", "PharmEasy", 5912, ["PHARMEASY", "API HOLDINGS"], ["pharmacy"]),
    ("apollo", "Apollo Pharmacy", 5912, ["APOLLO", "APOLLO PHARMACY"], ["pharmacy"]),
    ("indian_oil", "Indian Oil", 5541, ["INDIAN OIL", "INDIANOIL", "IOCL"], ["fuel"]),
    ("hp_petrol", "HP Petrol Pump", 5541, ["HPCL", "HP PETROL", "HINDUSTAN PETROLEUM"], ["fuel"]),
    ("bharat_petroleum", "Bharat Petroleum", 5541, ["BPCL", "BHARAT PETROLEUM"], ["fuel"]),
]

# Category families, tried in this order.
FAMILIES = [
    (r"\b(FUEL|PETROL|DIESEL|PETROLEUM|GAS STATION)\b", 5541, ["fuel"]),
    (r"\b(TOLL|FASTAG|NHAI)\b", 4784, ["toll"]),
    (r"\b(RENT|RENTPAY|HOUSING RENT)\b", 6513, ["rent"]),
    (r"\b(INSURANCE|POLICY PREMIUM|LIC)\b", 6300, ["insurance"]),
    (r"\b(ELECTRICITY|BESCOM|MSEB|POWER BILL)\b", 4900, ["utility"]),
    (r"\b(RECHARGE|PREPAID|POSTPAID|BROADBAND)\b", 4814, ["telecom", "utility"]),
    (r"\b(HOSPITAL|CLINIC|DIAGNOSTIC|LAB)\b", 8062, ["health"]),
    (r"\b(SCHOOL|COLLEGE|UNIVERSITY|TUITION|EDUCATION)\b", 8220, ["education"]),
]

# Bank operations, tried in this order.
BANK_OPERATIONS = [
    (r"\b(ATM|CASH\s*WDL|CASH\s*WITHDRAWAL)\b", "atm"),
    (r"\b(INT\.?PD|INTEREST|CREDIT INTEREST)\b", "interest"),
    (r"\b(CHRG|CHARGES?|FEE|GST|SMS CHARGES)\b", "bank_charge"),
    (r"\b(SALARY|SAL CREDIT|NEFT CR)\b", "salary"),
    (r"\b(CHEQUE|CHQ|CLG)\b", "cheque"),
]

# Payment aggregators that stand before a star, and words that never name a merchant.
AGGREGATORS = ["RAZORPAY", "RAZP", "PAYU", "BILLDESK", "CCAVENUE", "PHONEPE", "PAYTM", "PINELABS", "CASHFREE", "INSTAMOJO"]
NOISE = ["INDIA", "IN", "PVT", "PRIVATE", "PRIVAT", "LTD", "LIMITED", "LLP", "COM", "ONLINE", "PAYMENT", "PAYMENTS", "UPI", "NA"]

_SCHEMA = "cat_ord int, merchant_id string, display_name string, mcc int, aliases array<string>, tags array<string>"


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *row) for k, row in enumerate(CATALOGUE)], _SCHEMA)


def exact_keys() -> dict[str, int]:
    """Upper-cased name -> catalogue position; later entries win."""
    keys: dict[str, int] = {}
    for k, (merchant, display, _, aliases, _) in enumerate(CATALOGUE):
        for name in (display, merchant, *aliases):
            keys[name.upper()] = k
    return keys


def names() -> list[tuple[int, int, str]]:
    """(catalogue position, name position, name): the display name first, then the aliases."""
    return [(k, j, n) for k, (_, display, _, aliases, _) in enumerate(CATALOGUE) for j, n in enumerate((display, *aliases))]
