"""Default word lists, patterns and constants.

Every value here is a *fixed value*: results only agree with the behaviour this engine
reproduces when these are exactly as written. All of them are defaults of function parameters
and can be overridden per call.
"""

# --- text cleaning -------------------------------------------------------------------------
# fixed values: elements whose content is never visible text
HIDDEN_TAGS = ["script", "style", "noscript", "iframe"]
# fixed values: page furniture removed before looking for the main content
CHROME_TAGS = [
    "nav", "header", "footer", "aside", "script", "style", "noscript", "iframe", "form", "ads", "svg",
]
# fixed values: a line equal to one of these (ignoring case) is boilerplate
BOILERPLATE_LINES = [
    "copyright", "all rights reserved", "privacy policy", "terms of service", "footer", "header",
]
# fixed values: English stop words
ENGLISH_STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom this "
    "that these those am is are was were be been being have has had having do does did doing a an "
    "the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then "
    "once here there when where why how all any both each few more most other some such no nor not "
    "only own same so than too very s t can will just don should now d ll m o re ve y ain aren "
    "couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn"
).split()

# --- structured data -----------------------------------------------------------------------
# fixed values: JSON-LD types that become leads, and itemtype words for microdata
LEAD_TYPES_JSONLD = ["Organization", "LocalBusiness", "Hotel", "Restaurant", "TouristAttraction"]
LEAD_TYPES_MICRODATA = ["organization", "business", "hotel", "restaurant", "touristattraction"]
# fixed values: JSON-LD types read for addresses and names, and the address part order
PLACE_TYPES_JSONLD = ["Organization", "LocalBusiness", "Place", "Hotel"]
ADDRESS_PARTS = ["streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry"]

# --- contacts ------------------------------------------------------------------------------
# fixed values: domains of social links in anchors, and of profile URLs in free text
SOCIAL_DOMAINS = [
    "facebook.com", "instagram.com", "twitter.com", "linkedin.com",
    "youtube.com", "t.me", "telegram.me", "wa.me", "whatsapp.com",
]
SOCIAL_PROFILE_HOSTS = ["facebook.com", "instagram.com", "twitter.com", "linkedin.com"]
# fixed values: last word of a business name
BUSINESS_WORDS = [
    "Hotel", "Resort", "Tours?", "Travel", "Restaurant", "Cafe", "Agency", "Lodge", "Inn",
    "Guesthouse", "Accommodation", "Booking", "Reservation",
]
# fixed values: last word of a street address
STREET_WORDS = [
    "Street", "Avenue", "Road", "Boulevard", "Lane", "Drive", "Place", "Court", "Way", "Terrace",
    "Close", "Crescent", "Grove", "Square", "Gardens", "Heights", "Manor", "Villa", "Apartment",
    "Suite", "Floor", "Building", "Center", "Centre", "Plaza", "Mall", "Complex", "District", "Area",
    "Zone", "City", "Town", "Village", "County", "State", "Province", "Country", "Postal", "Zip",
    "Code",
]
# fixed values: job titles
JOB_TITLES = [
    "CEO", "Founder", "Owner", "Manager", "Director", "President", "Principal", "Partner", "Head",
    "Lead", "Chairman", "Chief [A-Za-z ]+", "[A-Za-z]+ Officer",
]
# fixed values: role words before / after a person's name
ROLES_BEFORE_NAME = ["Manager", "Contact", "Director", "Owner", "Chef", "Guide"]
ROLES_AFTER_NAME = ["Manager", "Contact", "Director", "Owner"]
UNKNOWN_BUSINESS = "Unknown Business"
UNKNOWN_CONTACT = "Unknown Contact"
# fixed values: lead type by words in the business name, then by words in the text
LEAD_TYPE_BY_NAME = {
    "hotel": ["hotel", "resort", "lodge", "inn"],
    "restaurant": ["restaurant", "cafe", "dining"],
    "tour_operator": ["tour", "travel", "agency"],
}
LEAD_TYPE_BY_TEXT = {
    "hotel": ["hotel", "accommodation", "room", "booking"],
    "restaurant": ["restaurant", "dining", "food", "menu"],
    "tour_operator": ["tour", "excursion", "guide", "travel"],
}
# fixed values: confidence of each kind of lead
CONF_PAIR, CONF_EMAIL_ONLY, CONF_PHONE_ONLY = 0.8, 0.6, 0.5
CONF_FLAT_EMAIL, CONF_FLAT_PHONE, CONF_FLAT_NAME = 0.9, 0.8, 0.7
CONF_MODEL = 0.5

# --- classification ------------------------------------------------------------------------
# fixed values: verticals, content types, intents, spam patterns
VERTICALS = [
    "hotel", "resort", "hostel", "restaurant", "cafe", "tour operator", "travel agency", "blogger",
    "event organizer",
]
CONTENT_TYPES = {
    "business": ["hotel", "resort", "restaurant", "agency", "operator", "listing"],
    "blog": ["blog", "post", "story"],
    "review": ["review", "rating", "score"],
    "social": ["facebook", "instagram", "twitter", "linkedin"],
}
INTENTS = {
    "commercial": ["book", "reservation", "deal", "price", "offer", "buy", "sale"],
    "informational": ["guide", "tips", "review", "blog", "information", "how to"],
}
SPAM_PATTERNS = [r"free\s+gift", r"click here", r"subscribe now", r"win\s+money"]

# --- search --------------------------------------------------------------------------------
# fixed values: query term groups and default exclusions
TRAVEL_TERMS = ["travel", "vacation", "journey", "holiday", "tour", "visit", "trip"]
TARGET_GROUP_TERMS = [
    "traveler", "adventurer", "tourist", "visitor", "company", "corporate", "business", "group",
    "travel influencer", "blogger", "vlogger", "content creator", "tour operator", "bus operator",
    "travel agency", "event organizer", "event planner",
]
TRIP_TYPE_TERMS = ["planning", "plan a trip", "plan a tour", "plan a holiday", "plan a visit"]
EXCLUDED_TERMS = ["job", "career", "hiring", "free", "template", "sample"]
# fixed values: result hosts that are dropped, and result categories (blog is tested first here)
LOW_QUALITY_DOMAINS = ["pinterest.com", "yelp.com", "tripadvisor.com", "reddit.com", "quora.com"]
RESULT_CATEGORIES = {
    "blog": ["blog", "post"],
    "business": ["hotel", "resort", "restaurant", "agency", "operator"],
    "social": ["facebook", "instagram", "twitter", "linkedin"],
}
MAX_RESULTS = 30
CRAWLS_PER_SEARCH = 10

# --- links and frontier --------------------------------------------------------------------
# fixed values: words of links worth following; crawl limits
LINK_WORDS = [
    "hotel", "resort", "hostel", "restaurant", "tour", "travel", "blog", "event", "booking", "trip",
]
HTML_CONTENT_TYPES = ["text/html", "application/xhtml+xml", "application/xml"]
CRAWL_BUDGET = 100
CRAWL_DELAY_SECONDS = 2.0
MAX_RETRIES = 2
MAX_DEPTH = 2

# --- scoring -------------------------------------------------------------------------------
# fixed values: completeness weights in hundredths
COMPLETENESS_WEIGHTS = {
    "business_name": 20, "email": 20, "phone": 15, "website": 15, "address": 10,
    "contact_person": 10, "lead_type": 10,
}
TARGET_KEYWORDS = [
    "hotel", "resort", "hostel", "restaurant", "tour", "travel", "agency", "blogger", "event", "operator",
]
# fixed values: (age below this many days, hundredths), first band that applies
PUBLISHED_BANDS = [(30, 50), (180, 30), (365, 10)]
UPDATED_BANDS = [(30, 30), (180, 20), (365, 10)]
SOCIAL_BANDS = [(30, 20), (180, 10)]
REVIEW_BANDS = [(30, 10)]

# --- stored model responses ----------------------------------------------------------------
# fixed values: what a lead gets that the model left open
MODEL_LEAD_TYPE = "travel_business"
MODEL_METHOD = "ai_extraction"

# --- operations ----------------------------------------------------------------------------
# fixed values: job time limits in seconds
# and the messages of failed jobs
JOB_LATE = ("Job timed out after ", " seconds")
JOB_EMPTY = "No result or exception returned"
JOB_TIMEOUTS = {"search": 30.0, "crawl": 25.0, "lead_processing": 20.0}

# --- phone regions -------------------------------------------------------------------------
# fixed values from public numbering plans: region, calling code, trunk prefix, shortest and
# longest national number, leading digits a national number may have
PHONE_REGIONS = [
    ("IN", "91", "0", 10, 10, "1-9"), ("US", "1", "1", 10, 10, "2-9"), ("GB", "44", "0", 9, 10, "1-9"),
    ("FR", "33", "0", 9, 9, "1-9"), ("DE", "49", "0", 6, 13, "1-9"), ("ES", "34", "", 9, 9, "5-9"),
    ("IT", "39", "", 6, 11, "0-9"), ("NL", "31", "0", 9, 9, "1-9"), ("BE", "32", "0", 8, 9, "1-9"),
    ("CH", "41", "0", 9, 9, "2-9"), ("AT", "43", "0", 6, 13, "1-9"), ("PT", "351", "", 9, 9, "2-9"),
    ("IE", "353", "0", 7, 9, "1-9"), ("SE", "46", "0", 7, 10, "1-9"), ("NO", "47", "", 8, 8, "2-9"),
    ("DK", "45", "", 8, 8, "2-9"), ("FI", "358", "0", 6, 11, "1-9"), ("PL", "48", "", 9, 9, "1-9"),
    ("GR", "30", "", 10, 10, "2-9"), ("TR", "90", "0", 10, 10, "2-9"), ("RU", "7", "8", 10, 10, "3-9"),
    ("AE", "971", "0", 8, 9, "2-9"), ("SA", "966", "0", 9, 9, "1-9"), ("ZA", "27", "0", 9, 9, "1-9"),
    ("EG", "20", "0", 8, 10, "1-9"), ("KE", "254", "0", 9, 9, "1-9"), ("NG", "234", "0", 8, 10, "1-9"),
    ("AU", "61", "0", 9, 9, "2-8"), ("NZ", "64", "0", 8, 10, "2-9"), ("JP", "81", "0", 9, 10, "1-9"),
    ("CN", "86", "0", 9, 11, "1-9"), ("KR", "82", "0", 8, 10, "1-9"), ("SG", "65", "", 8, 8, "3-9"),
    ("MY", "60", "0", 8, 10, "1-9"), ("TH", "66", "0", 8, 9, "2-9"), ("ID", "62", "0", 8, 12, "1-9"),
    ("PH", "63", "0", 8, 10, "2-9"), ("VN", "84", "0", 9, 10, "2-9"), ("LK", "94", "0", 9, 9, "1-9"),
    ("NP", "977", "0", 8, 10, "1-9"), ("BD", "880", "0", 8, 10, "1-9"), ("PK", "92", "0", 9, 10, "2-9"),
    ("BR", "55", "0", 10, 11, "1-9"), ("MX", "52", "", 10, 10, "1-9"), ("AR", "54", "0", 10, 11, "1-9"),
]
DEFAULT_REGION = "IN"
# fixed values: calling codes of two and of three digits, as patterns; E.164 allows 15 digits in all
CALLING_CODES = r"^(?:(?:2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|(?:2[1-689]|3[578]|42|5[09]|6[789]|8[0578]|9[679])[0-9])"
NATIONAL_DIGITS = (4, 13)
