"""Word lists of the normalisers."""

# Fixed values.
LEGAL_TERMS = {
    "incorporated": "inc", "corporation": "corp", "company": "co",
    "limited": "ltd", "private": "pvt", "privatelimited": "pvt ltd",
    "llc": "llc", "llp": "llp", "p.l.l.c.": "llc", "l.l.c.": "llc",
    "enterprises": "enterprises", "enterprise": "enterprises",
    "services": "services", "service": "services",
    "solutions": "solutions", "solution": "solutions",
    "technologies": "technologies", "technology": "tech", "tech": "tech",
    "international": "intl", "holdings": "holdings", "group": "group",
    "consulting": "consulting", "associates": "assoc", "partners": "partners",
    "industries": "ind", "industry": "ind", "properties": "prop",
    "management": "mgmt", "center": "ctr", "centre": "ctr",
}
# Fixed values.
ADDRESS_ABBREVIATIONS = {
    "street": "st", "str": "st", "saint": "st",
    "road": "rd", "avenue": "ave", "av": "ave",
    "boulevard": "blvd", "drive": "dr", "lane": "ln",
    "court": "ct", "place": "pl", "square": "sq",
    "highway": "hwy", "parkway": "pkwy", "circle": "cir",
    "suite": "ste", "apartment": "apt", "building": "bldg",
    "floor": "fl", "ground floor": "gf", "first floor": "1f",
    "door no": "dno", "door number": "dno", "h no": "hno", "house no": "hno",
    "plot no": "plot", "sector": "sec", "block": "blk",
    "near": "nr", "opp": "opposite", "opposite": "opp",
    "po box": "pobox", "post office": "po",
    "north": "n", "south": "s", "east": "e", "west": "w",
    "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw",
}
# Fixed values.
STOPWORDS = [
    "the", "and", "a", "an", "of", "in", "on", "at", "by", "for", "with", "to",
    "dba", "d.b.a", "d/b/a", "aka", "a.k.a", "c/o", "care of",
]
# Fixed values.
GENERIC_NAME_TOKENS = [
    "inc", "corp", "co", "ltd", "pvt", "llc", "llp", "enterprises", "enterprise", "services", "service",
    "solutions", "solution", "tech", "technologies", "technology", "holdings", "holding", "group",
    "consulting", "consultants", "partners", "partner", "ind", "industries", "industry", "mgmt", "management",
    "ctr", "center", "centre", "shop", "store", "market", "hotel", "restaurant", "builders", "builder",
    "properties", "prop", "property", "realty", "realtors", "construction", "constructions", "developers",
    "developer", "agency", "agencies", "trading", "traders", "trade", "works", "logistics", "transport",
    "transports", "auto", "automobiles", "motors", "motor", "pharma", "pharmaceuticals", "finance",
    "financial", "financials", "capital", "ventures", "venture", "investments", "investment", "international",
    "intl", "commercial", "commercials", "global",
]
# Fixed values.
INDIC_TO_LATIN = {
    "एसएस": "ss", "फूड": "food", "प्राइवेट": "pvt", "लिमिटेड": "ltd",
    "रेड": "red", "वेंचर्स": "ventures", "होटल": "hotel", "एंटरप्राइजेज": "enterprises",
    "कंपनी": "company", "सर्विस": "services", "सोल्यूशन्स": "solutions",
    "उत्तर": "uttar", "प्रदेश": "pradesh", "हरियाणा": "haryana",
    "राजस्थान": "rajasthan", "कर्नाटक": "karnataka", "महाराष्ट्र": "maharashtra",
    "दिल्ली": "delhi", "गाजियाबाद": "ghaziabad", "फरीदाबाद": "faridabad",
    "जयपुर": "jaipur", "बैंगलोर": "bangalore", "कोलकाता": "kolkata",
}
# Fixed values.
PHRASE_ABBREVIATIONS = {
    "private limited": "pvt ltd", "incorporated": "inc", "corporation": "corp", "company": "co",
    "limited": "ltd", "llp": "llp", "street": "st", "road": "rd", "avenue": "ave",
    "boulevard": "blvd", "north": "n", "south": "s", "east": "e", "west": "w",
}
# Fixed values.
LEGAL_SUFFIX = r"(?i)\b(pvt ltd|private limited|inc|incorporated|corp|corporation|llc|ltd|limited|co)\b\.?"
