"""Lookup tables of the normalisation. Entries that would map a token to itself are left out."""

# Legal forms and common words of business names, and their canonical tokens.
LEGAL_CANON = {
    "corporation": "corp", "incorporated": "inc", "company": "co", "cos": "co", "limited": "ltd", "lmtd": "ltd",
    "grp": "group", "hldgs": "holdings", "enterprise": "enterprises", "ent": "enterprises",
    "assoc": "associates", "assocs": "associates", "international": "intl", "inds": "industries",
    "svcs": "services", "svc": "services", "srvcs": "services", "soln": "solutions", "solns": "solutions",
    "technology": "technologies", "tech": "technologies", "brothers": "bros",
    "private": "pvt", "pte": "pvt", "prv": "pvt",
    "societe": "ste", "cie": "co", "compagnie": "co", "etablissements": "ets", "et": "and",
}

# Tokens that are only legal form or article.
LEGAL_FORMS = (
    "corp inc co ltd llc llp lp plc pllc pc pa na pvt opc huf sarl sas sasu sa eurl sci snc scop ste ets "
    "the and of le la les de des du d l"
).split()
LEGAL_WORDS = "private limited corporation incorporated company societe compagnie etablissements".split()
NAME_NOISE = "m s ms mr mrs id www com the dba formerly fka aka known as".split()
COUNTRY_WORDS = "india france usa us america bharat".split()

# Address words and their abbreviations (United States, India, France).
ADDR_CANON = {
    "street": "st", "str": "st", "avenue": "ave", "av": "ave", "avn": "ave",
    "road": "rd", "boulevard": "blvd", "bd": "blvd", "boul": "blvd", "drive": "dr", "lane": "ln", "court": "ct",
    "place": "pl", "square": "sq", "highway": "hwy", "parkway": "pkwy", "circle": "cir", "terrace": "ter",
    "trail": "trl", "expressway": "expy", "freeway": "fwy", "turnpike": "tpke", "plaza": "plz",
    "suite": "ste", "apartment": "apt", "floor": "fl", "flr": "fl", "building": "bldg", "room": "rm",
    "number": "no", "num": "no", "nbr": "no", "north": "n", "south": "s", "east": "e", "west": "w",
    "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw", "mount": "mt", "saint": "st", "fort": "ft",
    "mg": "marg", "nagar": "ngr", "nager": "ngr", "colony": "col", "sector": "sec", "sect": "sec", "phase": "ph",
    "block": "blk", "opposite": "opp", "near": "nr", "behind": "bh", "bhd": "bh", "chowk": "chk", "cross": "crs",
    "main": "mn", "layout": "lyt", "extension": "extn", "ext": "extn", "industrial": "indl", "ind": "indl",
    "estate": "est", "area": "ar", "complex": "cmplx", "apartments": "apts", "society": "soc", "house": "hse",
    "tower": "twr", "post": "po", "district": "dist", "dt": "dist", "distt": "dist", "taluk": "tq", "taluka": "tq",
    "tehsil": "teh", "village": "vill", "vil": "vill", "galli": "gali", "bazaar": "bazar", "bzr": "bazar", "pincode": "pin",
    "r": "rue", "chemin": "ch", "che": "ch", "impasse": "imp", "allee": "all", "route": "rte", "quai": "qu",
    "cours": "crs", "faubourg": "fbg", "passage": "pass", "residence": "res", "lieu": "ld", "lieudit": "ld", "zone": "z",
}

# States of India and the United States by name, as whole address components.
STATES = {
    "maharashtra": "mh", "karnataka": "ka", "tamil nadu": "tn", "tamilnadu": "tn", "delhi": "dl", "new delhi": "dl",
    "uttar pradesh": "up", "gujarat": "gj", "rajasthan": "rj", "west bengal": "wb", "telangana": "ts", "tg": "ts",
    "andhra pradesh": "ap", "kerala": "kl", "madhya pradesh": "mp", "haryana": "hr", "punjab": "pb", "bihar": "br",
    "odisha": "od", "orissa": "od",
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co",
    "connecticut": "ct", "delaware": "de", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id",
    "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la",
    "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn",
    "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv",
    "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny", "north carolina": "nc",
    "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa",
    "rhode island": "ri", "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx",
    "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa", "west virginia": "wv",
    "wisconsin": "wi", "wyoming": "wy", "district of columbia": "dc",
}

# The skeleton's replacements, in order.
SKELETON_STEPS = [
    ("ph", "f"), ("sh", "s"), ("ch", "c"), ("kh", "k"), ("gh", "g"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("jh", "j"),
    ("ck", "k"), ("q", "k"), ("c", "k"), ("w", "v"), ("z", "j"), ("x", "ks"), ("y", "i"),
]

# Latin letters without a decomposition.
LATIN = {"ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "TH", "ł": "l", "Ł": "L", "ı": "i", "ħ": "h", "Ħ": "H", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-"}

# The Indic blocks share one layout; offset in the block -> letters.
INDIC_BLOCKS = (0x0900, 0x0980, 0x0A00, 0x0A80, 0x0B00, 0x0B80, 0x0C00, 0x0C80, 0x0D00)
INDIC = {
    0x02: "n", 0x03: "h", 0x05: "a", 0x06: "aa", 0x07: "i", 0x08: "ii", 0x09: "u", 0x0A: "uu", 0x0B: "r", 0x0E: "e",
    0x0F: "e", 0x10: "ai", 0x11: "o", 0x12: "o", 0x13: "o", 0x14: "au",
    0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "ng", 0x1A: "c", 0x1B: "ch", 0x1C: "j", 0x1D: "jh", 0x1E: "ny",
    0x1F: "tt", 0x20: "tth", 0x21: "dd", 0x22: "ddh", 0x23: "nn", 0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh",
    0x28: "n", 0x29: "nnn", 0x2A: "p", 0x2B: "ph", 0x2C: "b", 0x2D: "bh", 0x2E: "m", 0x2F: "y", 0x30: "r", 0x31: "rr",
    0x32: "l", 0x33: "ll", 0x34: "lll", 0x35: "v", 0x36: "sh", 0x37: "ss", 0x38: "s", 0x39: "h",
    0x3E: "aa", 0x3F: "i", 0x40: "ii", 0x41: "u", 0x42: "uu", 0x43: "r", 0x46: "e", 0x47: "e", 0x48: "ai", 0x49: "on",
    0x4A: "o", 0x4B: "o", 0x4C: "au",
} | {0x66 + d: str(d) for d in range(10)}

# Cyrillic, Greek, Hebrew and Arabic letters, in the order of their alphabets.
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e io zh z i i k l m n o p r s t u f kh ts ch sh shch  y  e iu ia".split(" ")))
CYRILLIC |= {"і": "i", "ї": "i", "є": "ie", "ґ": "g", "ў": "u", "ј": "j", "љ": "lj", "њ": "nj", "ћ": "c", "ђ": "dj", "џ": "dz"}
GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a b g d e z e th i k l m n x o p r s s t u ph kh ps o".split()))
HEBREW = dict(zip("אבגדהוזחטיךכלםמןנסעףפץצקרשת", " b g d h v z kh t y k k l m m n n s  p p ts ts k r sh t".split(" ")))
ARABIC = dict(zip("ءابتثجحخدذرزسشصضطظعغفقكلمنهويىةآأإؤئپچژگکی", " a b t th j h kh d dh r z s sh s d t z  g f q k l m n h w y a t a a a w y p ch zh g k y".split(" ")))

# Syllables that the names of kana spell otherwise than they sound.
KANA = {"si": "shi", "ti": "chi", "tu": "tsu", "hu": "fu", "zi": "ji", "di": "ji", "du": "zu"}
