"""Word lists, patterns and codes that results depend on.

Order is meaningful in every table.  Patterns use Java syntax.
"""

# Ordered corrections for reported town names (pattern, text).
TOWN_CORRECTIONS = [
    ("Hts", "Heights"),
    ("Hgts", "Heights"),
    ("Vlg", "Village"),
    ("Pk", "Park"),
    ("Mt", "Mount"),
    ("Spgs", "Springs"),
    ("Bridge View", "Bridgeview"),
    ("Mccook", "McCook"),
    ("McCook", "McCook"),
    ("Mc Cook", "McCook"),
    ("Matttenson", "Matteson"),
    ("Argo", "Summit"),
    ("Summit Argo", "Summit"),
    ("Summit Summit", "Summit"),
    ("Chicgo", "Chicago"),
    ("Chcago", "Chicago"),
    ("Chicsgo", "Chicago"),
    ("Chiago", "Chicago"),
    ("Chigago", "Chicago"),
    ("Chocago", "Chicago"),
    ("Desplaines", "Des Plaines"),
    ("Markjam", "Markham"),
    ("Matheson", "Matteson"),
    ("Barrinton", "Barrington"),
    ("Hrightds", "Heights"),
    ("Bellweood", "Bellwood"),
    ("Does Plaines", "Des Plaines"),
    ("(,|) Il", ""),
    ("Hangover Park", "Hanover Park"),
    ("Malrose Park", "Melrose Park"),
    ("Melrose Rark", "Melrose Park"),
    ("Merlose Park", "Melrose Park"),
    ("River Groove", "River Grove"),
    ("Schaumborg", "Schaumburg"),
    ("Summit Argo", "Summit"),
    (r"\.", ""),
    ("Cicerol1", "Cicero"),
    ("Schuanburg", "Schaumburg"),
    ("Henover", "Hanover"),
    ("Ciscero", "Cicero"),
    ("Eik Grove Village", "Elk Grove Village"),
    ("  ", " "),
    ("Harveh", "Harvey"),
    ("Harwoord Heights|Hradwood Heights", "Harwood Heights"),
    ("Oawlawn|Oakalwn", "Oak Lawn"),
    ("Olumpia Fields", "Olympia Fields"),
    ("Sauk Chicago Heights|S Chicago Heights", "South Chicago Heights"),
    ("Wilimwnte", "Wilmette"),
    ("Polas Park", "Palos Park"),
    ("Palos Holls", "Palos Hills"),
    ("Des Paines", "Des Plaines"),
    ("Elmwood Parke", "Elmwood Park"),
    ("  ", " "),
    ("Mrkham", "Markham"),
    ("La Grarge", "La Grange"),
    (",", ""),
    ("Lansaing", "Lansing"),
    ("Flossmour", "Flossmoor"),
    ("Buffulo Grove", "Buffalo Grove"),
    ("Counting Club Hills", "Country Club Hills"),
    ("Country Clb Hls", "Country Club Hills"),
    ("Eveergreen Park", "Evergreen Park"),
    ("Forest Park60130", "Forest Park"),
    ("Schriller Park", "Schiller Park"),
    ("Harwood Heishts", "Harwood Heights"),
    ("Harwoods Heights", "Harwood Heights"),
    ("Milothian", "Midlothian"),
    ("Mount Prosrect", "Mount Prospect"),
    ("Oak Foest", "Oak Forest"),
    ("Orland Aprk", "Orland Park"),
    ("Whjeeling", "Wheeling"),
    ("Winnnetka", "Winnetka"),
    ("S Chiacgo Heights", "South Chiacgo Heights"),
    ("Arlington Heighra", "Arlington Heights"),
    ("Berwnyn|Brwyn|Berwyn I", "Berwyn"),
    ("Blue Islane|Blue Island D", "Blue Island"),
    ("Chicagi", "Chicago"),
    ("Chgo", "Chicago"),
    ("Cicerocicero", "Cicero"),
    ("`", ""),
    ("Despplaines", "Des Plaines"),
    ("E G Village|Elk Grv Vkg", "Elk Grove Village"),
    ("Elm Wood Park|Elmowood Park", "Elmwood Park"),
    ("Hickory Hils", "Hickory Hills"),
    ("Hillisde", "Hillside"),
    ("Indian Herd Patk", "Indian Head Park"),
    ("Ind Head Park", "Indian Head Park"),
    ("Mel Rose Park|Melrode Park", "Melrose Park"),
    ("Morto Grove|Morton Grv|Mortongrove", "Morton Grove"),
    ("Mount Propsect|Mount Prospct|Mount Prowpect", "Mount Prospect"),
    ("Foresst|Foreost", "Forest"),
    ("Orlaand|Oralnd", "Orland"),
    ("Orland Patk", "Orland Park"),
    ("Sachaumburg", "Schaumburg"),
    ("Schaumberg", "Schaumburg"),
    ("Schiiler", "Schiller"),
    ("Tinl Park|Tinle Park|Tinley Parl", "Tinley Park"),
    ("Wheeliing|Wheeliong", "Wheeling"),
    ("Cntry", "Country"),
    ("Elk Grove$", "Elk Grove Village"),
    ("Villag$", "Village"),
    ("Lagrange|LaGrange", "La Grange"),
    ("Oaklawn", "Oak Lawn"),
    ("So Chicago Heights", "South Chicago Heights"),
    ("Crestwook", "Crestwood"),
    (r"Palos\?heights", "Palos Heights"),
    ("N Riverside", "North Riverside"),
    ("Western Sprgs", "Western Springs"),
    ("Parkridge", "Park Ridge"),
    ("^Hoffman Est$|^Hoffam Estate$", "Hoffman Estates"),
    ("North Lake", "Northlake"),
    ("Hazelcrest", "Hazel Crest"),
    ("Rolling Mdws", "Rolling Meadows"),
    ("La Grange Highlands", "La Grange"),
]

# Normalisation before fuzzy matching, applied to title case.
# Only the compass letters and `So` need a word boundary on both sides.
TOWN_NORMALISATION = [
    (r"Hts\b", "Heights"),
    (r"Hgts\b", "Heights"),
    (r"Vlg\b", "Village"),
    (r"Pk\b", "Park"),
    (r"Mt\b", "Mount"),
    (r"\Spgs\b", "Springs"),
    (r"\bN\b", "North"),
    (r"\bS\b", "South"),
    (r"\bE\b", "East"),
    (r"\bW\b", "West"),
    (r"\.|,|`", ""),
    ("  ", " "),
    (r"\bSo\b", "South"),
    ("Mccook", "McCook"),
    ("La Grange Highlands", "La Grange"),
    (r"Summit Argo|Argo\b", "Summit"),
    ("Techny", "Northbrook"),
    (r"Chgo\b|Chg\b|Cgo\b|Chi\b", "Chicago"),
    (r"Illinois|Il\b", ""),
    (r"Parque\b", "Park"),
    ("Cc Hills", "Country Club Hills"),
]

# Town entries that mean "not given".
BLANK_TOWNS = [
    "Null", "Illinois", "Il", "Needs Updating", "", "Cook", "Unknown", "Homeless",
    "Cook County", "Lake", "Usa", "N", "N/A", "Illinois City", "N A",
]

# The town a matched neighbourhood belongs to.
ANCHOR_TOWN = "Chicago"

# Address words.  `SE` expands without its H.
ADDRESS_WORDS = [
    ("N", "NORTH"),
    ("S", "SOUTH"),
    ("E", "EAST"),
    ("W", "WEST"),
    ("SW", "SOUTHWEST"),
    ("NW", "NORTHWEST"),
    ("SE", "SOUTEAST"),
    ("NE", "NORTHEAST"),
    ("HWY", "HIGHWAY"),
    ("RD", "ROAD"),
    ("ST", "STREET"),
    ("AVE", "AVENUE"),
    ("AV", "AVENUE"),
    ("BLVD", "BOULEVARD"),
    ("DR", "DRIVE"),
    ("LN", "LANE"),
    ("CT", "COURT"),
]
ADDRESS_UNIT = r" (APT|#|ROOM|RM|UNIT|FL|STE|SUITE)(| )\d+"
ZIP_PLUS_FOUR = r"-\d{4}$"

# Suffixes and non-letters dropped from a person's name.  The
# trailing initial stands before \W so that it wins over its blank.
NAME_NOISE = r" JR| SR| \w$|\W"

# Race and ethnicity codes of the feed.
RACE_NOISE = ";UNK|;PHC1175|;NR"
HISPANIC_CODE = ";2135-2;"
RACE_LABELS = [
    (";2106-3;", "Non-Hispanic White"),
    (";2054-5;", "Non-Hispanic Black"),
    (";2131-1;", "Non-Hispanic Other Race"),
    (";2028-9;", "Non-Hispanic Asian"),
    (";1002-5;", "Non-Hispanic American Indian or Alaska Native"),
    (";2076-8;", "Non-Hispanic Native Hawaiian or Other Pacific Islander"),
    (";", "Unknown"),
]
HISPANIC_LABEL = "Hispanic/Latino"
MULTIPLE_LABEL = "Non-Hispanic Multiple Races"
UNKNOWN_LABEL = "Unknown"

# Wastewater plants (pattern, display name, short name).
PLANTS = [
    ("kirie", "Kirie, Mid Northwest Suburbs", "kirie"),
    ("egan", "Egan, Far Northwest Suburbs", "egan"),
    ("hanover", "Hanover Park, Far Northwest Suburbs", "hanover"),
    ("brien", "O'Brien, Northeast Suburbs and Chicago", "obrien"),
    (" sws", "Stickney, West Suburbs and Chicago (South Site)", "stickney south"),
    (" ws", "Stickney, West Suburbs and Chicago (North Site)", "stickney north"),
    ("lemont", "Lemont, Far Southwest Suburbs", "lemont"),
    ("calumet", "Calumet, South Suburbs and Chicago", "calumet"),
]
PLANT_COUNTY = 17031
PLANT_LOCATION = "wwtp"
LATE_SITE = "lemont"
SITE_COUNT = 8
WASTEWATER_TARGETS = {
    "flu_a": "inf_a_copies_l_wastewater",
    "flu_b": "inf_b_copies_l_wastewater",
    "sars_cov2": "pcr_target_avg_conc",
    "rsv": "rsv_copies_l_wastewater",
}
WASTEWATER_NAMES = {
    "marker_mean": "pmmov_ref_conc_site",
    "flow_mean": "flow_rte_site_avg",
    "pcr_target_avg_conc": "sars_cov2_copies_l_wastewater",
}

# Units outside the jurisdiction.
EXCLUDED_PLACES = [
    "Chicago city, Illinois",
    "Evanston city, Illinois",
    "Skokie village, Illinois",
    "Oak Park village, Illinois",
]
EXCLUDED_TOWNSHIP = "Stickney township, Cook County, Illinois"
MASK_PLACES = ["Evanston", "Oak Park", "Skokie"]
MASK_TOWNSHIPS = ["Stickney", "Chicago"]
PLACE_SUFFIX = r" (village|town|city|CDP), Illinois"
EXTRA_PLACE = "Hines"
EXTRA_ZIP = "60141"

# Case triage.
CLOSED_STATUSES = ["Closed", "Completed - Needs Closure"]

# Geocoder batch limit.
BATCH_LIMIT = 2000

# Geography clauses of the census API.
CLAUSE_PLACE_IN_COUNTY = "&for=county%20(or%20part):031&in=state:17%20place:"
CLAUSE_PLACE = "&for=place:"
CLAUSE_PLACE_STATE = "&in=state:17"
CLAUSE_ZCTA = "&for=zip%20code%20tabulation%20area:"

# Query options of the single-address geocoder.
GEOCODE_OPTIONS = (
    "&SingleLine=&outFields=*&maxLocations=1&matchOutOfRange=false&langCode=&locationType="
    "&sourceCountry=&category=&location=&distance=&searchExtent=&magicKey=&f=pjson"
)
GEOCODE_OPTIONS_ONE_LINE = (
    "&outFields=*&maxLocations=1&matchOutOfRange=false&langCode=&locationType="
    "&sourceCountry=&category=&location=&distance=&searchExtent=&magicKey=&f=pjson"
)
STATE_PLANE = 3435
