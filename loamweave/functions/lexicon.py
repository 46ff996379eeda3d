"""The word lists and tables that normalised names and addresses rest on.

All values in this module are fixed: results depend on each of them.
"""

# legal forms and connecting words
LEGAL = """inc incorporated llc l c ltd limited private pvt corp corporation co company llp plc lp pllc pc pa
lcsw pty gmbh the and of sarl sas sasu eurl ei sa sci snc scop cie et fils com www in net org""".split()
HONORIFICS = "mr mrs ms smt dr messrs shrimati kumari".split()
SRI = {"sri": "sri", "shri": "sri", "shree": "sri", "sree": "sri", "shreee": "sri"}
DESCRIPTORS = """center centre services service partners partner group associates solutions enterprises enterprise
trading traders holdings international global industries industry technologies technology tech systems system sys
consultants consulting management ventures labs lab business worldwide products brothers bros sons india usa
america sri a s m""".split()
VARIANTS = {"lakshmi": "laxmi", "laxmee": "laxmi", "jai": "jay", "jaya": "jay", "centre": "center", "organisation": "organization"}
MARKERS = "dba nee aka fka tradingas formerly".split()
ALIASES = ["trading as", "t/a", "doing business as", "d/b/a", "dba", "formerly known as", "formerly", "f/k/a", "fka", "also known as", "a/k/a", "aka", "nee", "known as"]
SITE_ENDINGS = "com in net org co fr biz info".split()
# sounds, replaced in this order
SOUNDS = [("ph", "f"), ("sh", "s"), ("ch", "c"), ("th", "t"), ("kh", "k"), ("gh", "g"), ("bh", "b"), ("dh", "d"), ("w", "v"), ("q", "k"), ("c", "k"), ("z", "j"), ("x", "ks"), ("g", "j"), ("m", "n")]
# words that sources add to a name
FILLERS = """center centre services service partners sri enterprises trading one sys labs group groupe developpement
associes associates frs freres france india cie""".split()
# families of legal forms: as pair features, and as a decision rule
FAMILIES = {"private": "pvt", "pvt": "pvt", "limited": "ltd", "ltd": "ltd", "llp": "llp", "inc": "inc", "incorporated": "inc", "llc": "llc", "pllc": "pllc", "corp": "corp", "corporation": "corp", "co": "co", "company": "co", "sarl": "sarl", "sas": "sas", "sasu": "sas", "eurl": "eurl", "sa": "sa"}
VETO_FAMILIES = {"private": "pvt", "pvt": "pvt", "limited": "ltd", "ltd": "ltd", "llp": "llp", "inc": "inc", "incorporated": "inc", "llc": "llc", "pllc": "pllc", "corp": "corp", "corporation": "corp", "sarl": "sarl", "sas": "sas", "sasu": "sasu", "eurl": "eurl", "sa": "sa", "sci": "sci", "snc": "snc", "ei": "ei"}
TYPO_KINDS = ["digit_added_or_lost", "one_digit_sub_big", "zeros"]
NEIGHBOUR_KINDS = ["one_digit_sub_small", "near_value", "transposed", "na"]

STREETS = {
    "street": "st", "str": "st", "saint": "st", "road": "rd", "avenue": "ave", "av": "ave", "drive": "dr", "lane": "ln",
    "court": "ct", "terrace": "ter", "terr": "ter", "boulevard": "blvd", "bd": "blvd", "bld": "blvd", "highway": "hwy",
    "place": "pl", "square": "sq", "circle": "cir", "parkway": "pkwy", "trail": "trl", "mount": "mt", "fort": "ft",
    "township": "twp", "apartment": "apt", "appt": "apt", "suite": "ste", "sector": "sec", "building": "bldg",
    "north": "n", "south": "s", "east": "e", "west": "w", "near": "nr", "opposite": "opp", "opp": "opp", "rue": "r",
    "cours": "crs", "impasse": "imp", "chemin": "che", "route": "rte", "allee": "all", "quai": "qu", "centre": "ctr", "center": "ctr",
}
CITIES = {
    "bangalore": "bengaluru", "bombay": "mumbai", "madras": "chennai", "calcutta": "kolkata", "gurgaon": "gurugram",
    "poona": "pune", "trivandrum": "thiruvananthapuram", "cochin": "kochi", "mysore": "mysuru", "baroda": "vadodara",
    "belgaum": "belagavi", "mangalore": "mangaluru", "allahabad": "prayagraj", "simla": "shimla", "benares": "varanasi",
    "banaras": "varanasi", "pondicherry": "puducherry",
}
ADDRESS_NOISE = """no number unit po box pmb null none na nil door house hno hn h plot block blk flat shop floor fl cdp
county city district dist region off at post via ground gf premises twp suburban urban of incorporated rdc rez chaussee""".split()
ORDINALS = dict(zip("first second third fourth fifth sixth seventh eighth ninth tenth".split(), map(str, range(1, 11)), strict=True))
GENERIC = """st rd ave dr ln ct ter blvd hwy pl sq cir pkwy trl way apt ste sec bldg n s e w nr opp r crs imp che rte all qu
main nagar colony phase town village park road marg area layout extension ext cross industrial estate""".split()
STATES = {
    "US": {
        "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co",
        "connecticut": "ct", "delaware": "de", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id",
        "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me",
        "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo",
        "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm",
        "new york": "ny", "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or",
        "pennsylvania": "pa", "rhode island": "ri", "south carolina": "sc", "south dakota": "sd", "tennessee": "tn",
        "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa", "west virginia": "wv",
        "wisconsin": "wi", "wyoming": "wy", "district of columbia": "dc",
    },
    "India": {
        "delhi": "dl", "new delhi": "dl", "nct of delhi": "dl", "dilli": "dl", "maharashtra": "mh", "mharastr": "mh",
        "tamil nadu": "tn", "tamilnadu": "tn", "tmilnatu": "tn", "karnataka": "ka", "krnatk": "ka", "uttar pradesh": "up",
        "uttr prdes": "up", "gujarat": "gj", "gujrat": "gj", "west bengal": "wb", "pscimbng": "wb", "telangana": "tg",
        "telmgan": "tg", "haryana": "hr", "hriyana": "hr", "rajasthan": "rj", "rajsthan": "rj", "kerala": "kl",
        "keralam": "kl", "kerlm": "kl", "bihar": "br", "madhya pradesh": "mp", "mdhy prdes": "mp", "andhra pradesh": "ap",
        "amdhrprdes": "ap", "punjab": "pb", "pmjab": "pb", "odisha": "od", "orissa": "od", "od isa": "od", "odisa": "od",
        "assam": "as", "jharkhand": "jh", "chhattisgarh": "cg", "uttarakhand": "uk", "himachal pradesh": "hp", "goa": "ga",
        "chandigarh": "ch", "jammu and kashmir": "jk", "puducherry": "py",
    },
    "France": {
        "hauts de france": "hdf", "nord": "hdf", "pas de calais": "hdf", "nouvelle aquitaine": "naq", "gironde": "naq",
        "pays de la loire": "pdl", "loire atlantique": "pdl",
    },
}
# Legal-form words at the end of raw names.
LEGAL_TAIL = "llc inc corp ltd limited pvt private pllc pc lp llp co sa sas sasu sarl eurl sci snc ei pa".split()
# Kinds of a labelled country's rescues that hold for a country without labels.
SAFE_NAMES = ["identical", "typo", "drop_word", "reorder", "filler_for_word", "initialism"]
SAFE_NUMBERS = ["same", "blank", "no_num", "overlap:subset", "conflict:digit_added_or_lost", "conflict:one_digit_sub_big", "conflict:zeros"]
