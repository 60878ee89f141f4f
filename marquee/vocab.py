"""Vocabularies the operators read.

Everything in this module is fixed data: labels, word lists and patterns whose values decide the result
of an operator. Operators take them as arguments with these as the defaults, so a deployment can pass its
own tables. Patterns are written in the subset that Java regex and RE2 share (no lookaround), so the same
text drives the Spark expression and the DuckDB check.
"""

# --- Fixed values: category taxonomy, parent -> source labels ---------------------------------------
TAXONOMY = {
    "Music": ["Music", "Parties & DJs"],
    "Theater": ["Theater", "Theatre", "Theatre & Performing Arts", "Arts & Theatre"],
    "Arts": ["Arts", "Arts & Culture", "Arts & Crafts", "Poetry & Literary", "Arts & Theatre"],
    "Comedy": ["Comedy"],
    "Film": ["Film", "TV & Film"],
    "Community": ["Community", "Activism & Community Events", "Charity"],
    "Tech / Educational": ["Tech / Educational"],
    "Health & Wellness": ["Health & Wellness"],
    "Food & Drink": ["Food & Drink", "Happy Hour / Specials"],
    "Sports": ["Sports", "Sports & Fitness"],
    "LGBTQ": ["LGBTQ"],
    "Karaoke/Trivia/Open Mics": ["Karaoke/Trivia/Open Mics"],
    "Holiday & Seasonal": ["Holiday & Seasonal", "Halloween"],
    "Festival": ["Festival"],
    "Shopping": ["Shopping"],
    "Other": ["Other", "Events", "Miscellaneous", "Cannabis"],
}

# --- Fixed values: concept -> canonical label, query words, category prefixes, claimed labels --------
CONCEPTS = {
    "music": ("Music", ["music", "concert", "band", "dj", "acoustic", "gig", "live music", "blues", "jazz",
                        "funk", "r&b", "hip hop", "rap", "techno", "punk", "metal", "indie", "folk",
                        "bluegrass", "reggae", "salsa", "cumbia", "mariachi", "orchestra", "symphony",
                        "opera", "choir", "dj set"], ["music"], []),
    "comedy": ("Comedy", ["comedy", "stand-up", "standup", "laugh", "improv"], ["comedy"], []),
    "theater": ("Theater", ["theater", "theatre", "play", "drama", "broadway", "musical"],
                ["theater", "theatre"], ["Arts & Theatre"]),
    "art": ("Arts", ["art", "arts", "gallery", "exhibition", "exhibit", "installation", "mural"],
            [], ["Arts", "Arts & Crafts", "Arts & Culture"]),
    "film": ("Film", ["film", "movie", "cinema", "screening"], ["film", "tv"], []),
    "food": ("Food & Drink", ["food", "dining", "restaurant", "chef", "cooking", "tasting", "brunch",
                              "oktoberfest", "mocktoberfest", "beer garden", "wine", "cocktail", "whiskey",
                              "brewery"], ["food"], []),
    "sports": ("Sports", ["sports", "sport", "game", "match", "tournament", "athletic", "marathon",
                          "triathlon", "5k", "10k", "fun run", "half marathon"], ["sport"], []),
    "community": ("Community", ["community", "volunteer", "meetup", "meeting", "user group", "workshop",
                                "class", "potluck", "mixer", "social"], ["community", "activism"], []),
    "wellness": ("Health & Wellness", ["wellness", "yoga", "meditation", "fitness", "health"],
                 ["health"], []),
    "education": ("Tech / Educational", ["lecture", "seminar", "talk", "talks", "panel", "symposium",
                                         "hack night", "open hack", "hack day", "astronomy", "astronomer",
                                         "astrophysicist", "observation", "in conversation", "science",
                                         "stem", "coding", "hackathon"], ["tech"], []),
    "lgbtq": ("LGBTQ", ["lgbtq", "lgbt", "queer", "pride", "drag"], ["lgbtq"], []),
    "holiday": ("Holiday & Seasonal", ["halloween", "haunted", "haunt", "spooktacular", "spooky",
                                       "jack-o-lantern", "trick or treat", "day of the dead",
                                       "dia de los muertos", "christmas", "holiday", "hanukkah", "kwanzaa",
                                       "new year", "nye", "thanksgiving", "easter", "valentine",
                                       "lunar new year", "juneteenth", "nightmare", "costume", "creepy",
                                       "terror", "dracula", "zombie", "howl-o-ween", "all hallows"],
                ["holiday"], []),
    "shopping": ("Shopping", ["market", "expo", "vintage", "flea", "bazaar", "pop-up", "trunk show",
                              "makers", "handmade", "shopping"], ["shopping"], []),
}

# --- Fixed values: label words ------------------------------------------------------------------------
ACRONYMS = ["LGBTQ", "TV", "DJ", "DJS", "BYOB", "NYE", "EDM", "RSVP", "ASL"]
UNINFORMATIVE = ["events", "miscellaneous", "other", "uncategorized"]
PLACEHOLDER = "undefined"
GENERIC_CATEGORY = "Events"
GENERIC_PARENT = "Other"
JUNK_CATEGORIES = ["undefined", "miscellaneous", "events", "other", "online search"]
CATEGORY_DATE_PATTERNS = [
    r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)",
    r"^\d+\s*,",
    r"until\s+",
    r"\d",
]
GREETING_CATEGORIES = ["Comedy", "Music", "Theater", "Holiday & Seasonal", "Arts", "Film", "Food & Drink",
                       "Festival"]

# --- Fixed values: narrow title rules, in order; a fixture needs both of its patterns ----------------
FIXTURE_TEAM = (r"(?i)\b(?:volleyball|basketball|soccer|hockey|baseball|football|lacrosse|rugby|softball"
                r"|tennis|wrestling|bulls|blackhawks|bears|cubs|white sox|sky|fire|red stars|sting)\b")
FIXTURE_VERSUS = r"(?i)\bv(?:s\.?)?\b"
TITLE_RULES = [
    ("Comedy", r"(?i)\bcomedy\b|\bstand[- ]?up\b|\bimprov\b"),
    ("Karaoke/Trivia/Open Mics", r"(?i)\b(karaoke|trivia|bingo|open[- ]mic)\b"),
    ("Arts & Crafts", r"(?i)\b(sewing|knit|crochet|quilt|pottery|ceramics?|life drawing)\b"),
    ("Food & Drink", r"(?i)\b(wine wednesday|happy hour|bottomless|drag brunch|supper club)\b"
                     r"|\bhalf[- ]price[d]?\s+(wine|beer|drink)|\b(beer|whiskey|wine) tasting\b"),
]

# --- Fixed values: query language ---------------------------------------------------------------------
STOP_WORDS = [
    "whats", "wheres", "whos", "hows", "thats", "dont", "doesnt", "didnt", "cant", "wont", "isnt", "arent", "im",
    "ive", "ill", "id", "youre", "its", "lets", "theres", "heres", "who", "how", "the", "a", "an", "and", "or",
    "is", "are", "in", "on", "at", "this", "that", "these", "those", "what", "when", "where", "why", "find", "get",
    "search", "show", "tell", "give", "all", "want", "looking", "events", "event", "i", "to", "for", "any",
    "chicago", "city", "illinois", "windy", "area", "town", "region", "like", "would", "see", "me", "my", "please",
    "can", "could", "need", "there", "some", "something", "anything", "know", "about", "happening", "going", "got",
    "have", "has", "near", "around", "list", "today", "tonight", "tomorrow", "weekend", "week", "month", "year",
    "next", "upcoming", "soon", "now", "weekends", "nights", "night",
]
CONTRACTIONS = ["'s", "'ll", "'re", "'ve", "'d", "'m", "n't", "'t"]

# --- Fixed values: place names ------------------------------------------------------------------------
PLACE_ALIASES = {
    "lakeview": "Lake View",
    "wrigleyville": "Lake View",
    "boystown": "Lake View",
    "northalsted": "Lake View",
    "ukie village": "Ukrainian Village",
    "the loop": "Loop",
    "south loop": "Near South Side",
    "bronzeville/douglas": "Bronzeville",
    "grand crossing": "Greater Grand Crossing",
    "mckinley park": "McKinley Park",
    "near north side": "Streeterville",
}

# --- Fixed values: enrichment patterns, in order ------------------------------------------------------
COST_FREE = r"(?i)\b(?:free|no charge|no admission fee)\b"
COST_DONATION = r"(?i)\b(?:donation|suggested donation|pwyc|pay what you can)\b"
COST_AMOUNT = r"(?i)\$\d+(?:\s*[-–to]+\s*\$?\d+)?"
COST_PAID = r"(?i)\b(?:paid event|ticketed)\b"
AGE_NUMBER = [
    r"(?i)\b(\d{1,2})\+",
    r"(?i)\b(\d{1,2})\s+and\s+over\b",
    r"(?i)\b(\d{1,2})\s+(?:and\s+)?up\b",
    r"(?i)\b(\d{1,2})\s+years?\s+(?:old|of age)\b",
    r"(?i)\bminimum age[:\s]+(\d{1,2})\b",
]
AGE_ALL = r"(?i)\b(?:all ages|family friendly|family-friendly)\b"
AGE_KIDS = r"(?i)\b(?:kids?\s+friendly|for kids?|family event)\b"
OUTDOOR = (r"(?i)\b(?:outdoor|outside|park|lakefront|plaza|rooftop|beach|pier|trail|garden|botanical)\b"
           r"|\b(?:in the park|at the lake|along the river)\b")
INDOOR = (r"(?i)\b(?:indoor|inside|theater|theatre|lounge|venue|nightclub|museum|gallery|hall|arena|stadium"
          r"|auditorium)\b|\b(?:at the|chicago loop|downtown)\b")
STREET_ADDRESS = (r"(?i)\b(\d+\s+[A-Za-z\s]+(?:St|Street|Ave|Avenue|Blvd|Boulevard|Rd|Road|Dr|Drive|Way|Lane"
                  r"|Ln|Ct|Court|Pl|Place)\.?[^,]*)")
VENUE_AFTER_AT = r"(?i)\bat\s+(?:the\s+)?([A-Za-z\s&'-]+?)(?:\s+-|\s+on|\s+\(|$)"
CITY_BEFORE_STATE = r"(?i),\s*([A-Za-z][A-Za-z .'-]{2,30}?),?\s+(?:IL|Illinois)\b"
HOME_CITY = ["chicago", "chicago il", "city of chicago"]
CARD_CLOCK = r"\d{1,2}:\d{2}\s*[APap]\.?[Mm]\.?"
CARD_SPAN = r"\$\s?(\d{1,4})(?:\.\d{2})?\s*(?:-|–|to)\s*\$?\s?(\d{1,4})"
CARD_ONE = r"\$\s?(\d{1,4})(?:\.(\d{2}))?"
CARD_FROM = r"(?i)\b(?:starting at|starts at|from|tickets from)\b"
CARD_DONATION = r"(?i)\bdonation\b|\bpay what you (?:can|wish)\b"
OFFER_PRICE_KEYS = ["price", "lowPrice", "highPrice", "minPrice", "maxPrice"]

# --- Fixed values: title shape ------------------------------------------------------------------------
NOT_AN_EVENT = [
    r"(?i)\s[|\x{2013}\x{2014}]\s.*(department|library|university|college|museum|center|centre|institute)",
    r"(?i)\bsearch results\b|\bgoogle search\b",
    r"(?i)^(public\s+)?events?\b.*\|",
    r"(?i)\bevents? in chicago\b",
    r"(?i)\blink in bio\b|\bswipe\b|\bdm (us|me)\b|\bfollow us\b",
]
TITLE_LEAD_WORDS = r"(?i)^(and|but|or|doing|featuring|with|plus|see|click)\b"
TITLE_STATUS = r"(?i)\b(closed|cancelled|canceled|sold out|tba|tbd|multiple days|coming soon|more info)\b"
LABEL_DATE_LIKE = r"(?i)\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.?\s*\d"

# --- Fixed values: text safety, in order --------------------------------------------------------------
INJECTION_ALLOW = [
    r"(?i)instructions for making",
    r"(?i)system administrator",
    r"(?i)what is your",
]
INJECTION = [
    r"(?i)(ignore|forget|discard).*(?:instructions|system prompt|rules|guidelines)",
    r"(?i)(from now on|you are|you will be|pretend you are|act as)",
    r"(?i)(override|bypass|disable).*(?:safety|filter|guard)",
    r"(?i)(show|reveal|print|display).*(?:system prompt|instructions|rules)",
    r"(?i)(what is your|what's your|repeat your).*(?:system|prompt|instruction)",
    r"';.*(?:DROP|DELETE|INSERT|UPDATE|SELECT)",
    r"^.*[{}\[\]`$()&|;<>].*(?:import|exec|eval|__)",
    r"(?i)---+\s*(?:SYSTEM|INSTRUCTION)",
    r"(?i)\[SYSTEM\]|\[INSTRUCTIONS\]|\[CONSTRAINT\]",
    r"(?i)(?:call|execute|invoke).*(?:search_google|delete_db|admin)",
]
LEAKS = [
    r"(?i)(?:api_key|apikey|api-key|secret|password|token)\s*[=:]\s*['\"]?[a-zA-Z0-9_-]+",
    r"(?i)(?:system prompt|system instructions|instructions are)",
    r"(?i)(?:database|sql|query)\s*(?:string|connection|config)",
    r"(?i)(?:claude|openai).*(?:api|key|secret|credential)",
]
SECRET_ASSIGNMENT = r"(?i)(?:api_key|apikey|token|secret)\s*[=:]\s*['\"]?[a-zA-Z0-9_-]+['\"]?"
PROMPT_LINE = r"(?i)(?:system prompt|instructions?|rules?)[:\s]*[^\n]*"
BLOCK_AFTER = 3
MAX_SAFE_INPUT = 5000

# --- Fixed values: conversation budget ----------------------------------------------------------------
TOKEN_BUDGET = 20000
TURN_BUDGET = 12
WARN_SHARE = 0.25

# --- Fixed values: boundary names folded into known places --------------------------------------------
BOUNDARY_ALIASES = {
    "wrigleyville": "Lake View",
    "boystown": "Lake View",
    "sheffield & depaul": "Lincoln Park",
    "united center": "Near West Side",
    "printers row": "Loop",
    "millenium park": "Loop",
    "grant park": "Loop",
    "museum campus": "Loop",
    "little italy, uic": "Little Italy",
    "sauganash,forest glen": "Forest Glen",
    "lower west side": "Pilsen",
    "douglas": "Bronzeville",
    "grand boulevard": "Bronzeville",
}

# --- Fixed values: street suffixes in their shortest form ---------------------------------------------
STREET_SUFFIXES = {
    "ave": "av", "avenue": "av", "av": "av", "st": "st", "street": "st", "rd": "rd", "road": "rd", "dr": "dr",
    "drive": "dr", "blvd": "bl", "boulevard": "bl", "pl": "pl", "place": "pl", "pkwy": "pk", "parkway": "pk",
    "ct": "ct", "court": "ct", "ter": "te", "terrace": "te", "ln": "ln", "lane": "ln", "hwy": "hw", "highway": "hw",
}

# --- Fixed values: geocoder key limits ----------------------------------------------------------------
MAX_ADDRESS_CHARS = 120
MAX_ADDRESS_WORDS = 12

# --- Fixed values: answers that mean a page is gone ---------------------------------------------------
GONE_CODES = [404, 410]

# --- Fixed values: broad directions and the neighborhoods they mean -----------------------------------
REGIONS = {
    "northwest side": ["Albany Park", "Avondale", "Belmont Cragin", "Dunning", "Forest Glen", "Galewood", "Hermosa",
                       "Irving Park", "Jefferson Park", "Logan Square", "Montclare", "North Park", "Norwood Park",
                       "O'Hare", "Portage Park"],
    "north side": ["Andersonville", "Edgewater", "Lake View", "Lincoln Park", "Lincoln Square", "North Center",
                   "North Park", "Rogers Park", "Uptown", "West Ridge"],
    "west side": ["Austin", "Garfield Park", "Humboldt Park", "Little Village", "Near West Side", "North Lawndale",
                  "Ukrainian Village", "West Loop", "West Town"],
    "south side": ["Armour Square", "Avalon Park", "Beverly", "Bridgeport", "Bronzeville", "Burnside", "Chatham",
                   "Chicago Lawn", "East Side", "Englewood", "Fuller Park", "Greater Grand Crossing", "Hegewisch",
                   "Hyde Park", "Kenwood", "New City", "Pullman", "Riverdale", "Roseland", "South Chicago",
                   "South Deering", "South Shore", "Washington Heights", "Washington Park", "West Pullman",
                   "Woodlawn"],
    "downtown": ["Loop", "Near South Side", "River North", "Streeterville", "West Loop"],
}

# --- Fixed values: what makes a request plainly about events in the city ------------------------------
EVENT_REQUEST_WORDS = (r"(?:concerts?|live music|shows?|events?|festivals?|performances?|workshops?|classes?|markets?"
                       r"|exhibitions?|plays?|games?|things to do|happening|comedy|theatre?)")

# --- Fixed values: candidate ceilings and confidence gates --------------------------------------------
CEILING_PLACED = 100
CEILING_OPEN = 50
TOP_RESULTS = 5
CONFIDENCE_FLOOR = 0.3
SEMANTIC_FLOOR = 0.25
SEMANTIC_K = 20
CATEGORY_FLOOR = 0.45

# --- Fixed values: price sentences of sources that print them, (pattern, mode) in order ---------------
# one: one amount; range: two amounts; all: every match's amount as one span
SOURCE_PRICE_RULES = {
    "chicago_park_district": [(r"(?i)Event Fee\s*\$(\d+(?:\.\d{2})?)", "one")],
    "chicago_venue_jazz_showcase": [(r"(?i)General Admission\s*\$(\d+)", "one"),
                                    (r"(?i)\$(\d+)\s*(?:-|—|–)?\s*general admission", "one")],
    "chicago_venue_old_town_school_of_folk_music": [(r"(?i)\$(\d+)\s+General Public", "one")],
    "chicago_venue_sleeping_village": [(r"(?i)(?:TIER\s*\d|EARLY BIRD|General Admission)\s*\$(\d+)(?:\.\d{2})?", "all")],
    "chicago_venue_goodman_theatre": [(r"(?i)\$(\d+)(?:\.\d{2})?\s+to\s+\$(\d+)(?:\.\d{2})?", "range")],
    "chicago_venue_den_theatre": [(r"(?i)Tickets:\s*\$(\d+)", "one")],
    "chicago_venue_beverly_arts_center": [(r"(?i)Tickets:\s*\$(\d+)", "one")],
    "chicago_venue_martyrss": [(r"(?i)\$(\d+)\s*adv\s*/\s*\$(\d+)\s*doors?", "range")],
    "chicago_venue_navy_pier": [(r"(?i)General admission is \$(\d+)", "one")],
}

# --- Fixed values: dates as venues print them ---------------------------------------------------------
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
          "november", "december"]
MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.?"
DATE_RUN = (rf"(?i)({MONTH})\s*(\d{{1,2}})\s*[–—-]\s*(?:[A-Za-z]{{3,9}},\s*)?"
            rf"(?:({MONTH})\s*)?(\d{{1,2}})(?:,?\s*(\d{{4}}))?")
DATE_ONE = rf"(?i)({MONTH})\s*(\d{{1,2}})(?:,?\s*(\d{{4}}))?"
WEEKDAY = (r"(?i)\b(?:Mon|Tue|Tues|Wed|Weds|Thu|Thur|Thurs|Fri|Sat|Sun)"
           r"(?:day|sday|nesday|rsday|urday)?\b")
CLOCK = r"(?i)\d{1,2}(?::\d{2})?\s*[ap]\.?m\.?"

# --- Fixed values: lines of a card that are not its title ---------------------------------------------
BOILERPLATE = ["tickets", "buy tickets", "more info", "learn more", "details", "sold out", "rsvp", "doors",
               "on sale", "free", "info", "read more", "get tickets"]
SECTION_HEADINGS = [
    "events", "all events", "upcoming events", "events & public programs", "public programs", "whats on",
    "calendar", "event calendar", "more events", "today", "tomorrow", "month", "week", "day", "list", "agenda",
    "view", "next", "prev", "previous", "filter", "filters", "search", "clear", "reset", "apply", "submit",
    "select date", "all", "close", "confirm", "cancel", "ok", "done", "more info", "sold out", "tickets", "time",
    "event details", "details", "venue", "location", "price", "multiday event", "multi day event",
    "single day event", "recurring event",
]
PICKER_LEADS = ["today ", "tomorrow ", "this week", "this month"]
TITLE_CUT = r"\s*[►▶‣]\s*|\s+DATE:\s*|\s+TIME:\s*"
GLUED_WEEKDAY = r"(?:Mon|Tues?|Wed(?:nes)?|Thu(?:rs)?|Fri|Sat(?:ur)?|Sun)(?:day)?\.?$"

# --- Fixed values: keys that names and addresses meet on, as (pattern, replacement) steps ----------------
VENUE_KEY = [(r"[^a-z0-9 ]+", ""), (r"\btheatre\b", "theater"), (r"^the\s+", ""), (r"(?:\s*\b(?:il|illinois|chicago))+\s*$", "")]
STREET_KEY = [(r"(?s),?\s*chicago\b.*", ""), (r"\b\d{5}(?:-\d{4})?\b", " "), (r"[^a-z0-9 ]", " ")]
PARK_KEY = [(r"\(.*?\)", " "), (r"\b(park|playlot|playground|field ?house|th)\b", " "), (r"[^a-z0-9 ]", " ")]
