"""Reference data of the pipeline: word lists, lookup tables, constants.

All values in this module are fixed values: results depend on them, so they are stated as they are, in their natural order.
Order matters wherever a list decides which of several matches wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Hazard types and their keywords.
HAZARDS = {
    "earthquake": ["earthquake", "seismic", "tremor", "aftershock"],
    "flood": ["flood", "flash flood", "inundation", "overflow"],
    "cyclone/storm": ["cyclone", "storm", "hurricane", "typhoon", "tropical storm"],
    "wildfire": ["wildfire", "forest fire", "bushfire"],
    "landslide": ["landslide", "mudslide", "rockslide"],
    "heatwave": ["heatwave", "extreme heat", "high temperature"],
    "conflict emergency": ["conflict", "displacement", "armed clashes", "violence"],
    "epidemic/disease outbreak": [
        "epidemic", "disease outbreak", "outbreak", "pandemic", "cholera", "measles", "ebola", "malaria", "dengue", "disease", "infectious", "meningitis", "polio",
        "avian flu", "bird flu", "yellow fever", "plague", "public health emergency", "health emergency",
    ],
    "drought": ["drought", "dry spell", "water scarcity", "famine", "food insecurity", "crop failure", "water shortage", "desertification", "arid"],
    "volcanic eruption": ["volcano", "volcanic", "eruption", "lava", "ash cloud", "pyroclastic", "magma"],
    "tsunami": ["tsunami", "tidal wave"],
}

# The conflict rule's words.
CONFLICT_STRONG = ["armed conflict", "armed clashes", "fighting", "war", "militia", "airstrike", "bombing", "shelling", "insurgency", "attack", "attacks", "violence"]
CONFLICT_IMPACT = ["displaced", "displacement", "idp", "refugee", "humanitarian", "casualties", "killed", "injured", "deaths", "food insecurity", "protection"]

# Other names of each hazard, after _ / - have become spaces.
HAZARD_ALIASES = {
    "earthquake": ["earthquake", "earthquakes", "quake", "quakes", "seismic"],
    "flood": ["flood", "floods", "flooding"],
    "cyclone/storm": ["cyclone storm", "cyclone", "cyclones", "storm", "storms", "tropical cyclone", "hurricane", "typhoon"],
    "wildfire": ["wildfire", "wildfires", "fire", "fires", "bushfire", "bushfires"],
    "landslide": ["landslide", "landslides", "mudslide", "mudslides"],
    "heatwave": ["heatwave", "heatwaves", "heat wave", "heat waves"],
    "conflict emergency": ["conflict emergency", "complex emergency", "conflict", "conflicts"],
    "epidemic/disease outbreak": ["epidemic disease outbreak", "epidemic", "epidemics", "disease outbreak", "disease", "outbreak", "pandemic", "cholera", "measles", "ebola", "malaria"],
    "drought": ["drought", "droughts", "dry spell", "water scarcity"],
    "volcanic eruption": ["volcanic eruption", "volcano", "eruption"],
    "tsunami": ["tsunami", "tsunamis", "tidal wave"],
}

# Impact, need and risk keywords.
IMPACTS = {
    "people_impact": ["deaths", "killed", "fatalities", "dead", "missing", "injured", "casualties", "displaced", "evacuated"],
    "housing_lc_impact": ["houses destroyed", "houses damaged", "homes destroyed", "homes damaged", "housing", "shelter"],
    "infrastructure_impact": ["bridge", "road", "highway", "port", "airport", "power", "electricity", "grid", "infrastructure"],
    "services_impact": ["hospital", "health facility", "clinic", "school", "water supply", "sanitation"],
    "systems_impact": ["market", "supply chain", "food system", "agriculture", "fisheries", "livelihoods"],
}
NEEDS = {
    "food_security": ["food", "hunger", "nutrition", "malnutrition", "famine", "food insecurity", "crop", "harvest"],
    "health": ["health", "medical", "cholera", "malaria", "dengue", "disease", "epidemic", "outbreak", "medicine"],
    "wash": ["water", "sanitation", "hygiene", "wash", "contamination", "borehole", "latrine"],
    "protection": ["protection", "gbv", "child protection", "trafficking", "violence"],
    "education": ["school", "education", "learner", "student", "teacher", "classroom"],
    "shelter": ["shelter", "housing", "accommodation", "tent", "tarpaulin", "nfi"],
    "logistics": ["logistics", "transport", "access", "road", "bridge", "supply"],
}
RISKS = ["forecast", "outlook", "prediction", "warning", "alert", "expected", "anticipated", "risk", "likelihood", "probability", "projection"]

# Response actors in the order in which they are looked for.
ACTORS = {
    "un": "un_agency", "ocha": "un_agency", "unicef": "un_agency", "wfp": "un_agency", "who": "un_agency", "unhcr": "un_agency",
    "ifrc": "redco", "red cross": "redco", "red crescent": "redco",
    "government": "government", "ministry": "government", "national disaster": "government", "ingd": "government", "cenoe": "government",
    "ngo": "ngo", "care": "ngo", "oxfam": "ngo", "msf": "ngo", "save the children": "ngo", "cluster": "cluster",
}

# Hazard categories; any other hazard is meteorological.
HAZARD_CATEGORIES = {
    "cyclone/storm": "meteorological", "heatwave": "meteorological", "flood": "hydrological", "flash flood": "hydrological", "storm surge": "hydrological",
    "drought": "climatological", "wildfire": "climatological", "earthquake": "geophysical", "landslide": "geophysical", "tsunami": "geophysical",
    "conflict emergency": "conflict", "armed conflict": "conflict", "cholera": "health", "dengue": "health",
}
SUB_HAZARDS = ["high winds", "heavy rainfall", "storm surge", "riverine flooding", "flash flood", "coastal flood", "landslide", "mudslide", "hail"]

# Severity words, strongest first.
EVENT_SEVERITY = {
    "critical": ["evacuation", "mass casualty", "catastrophic", "state of emergency"],
    "high": ["fatal", "deaths", "major", "severe", "widespread"],
    "medium": ["warning", "alert", "watch", "advisory"],
}
SEVERITY_PHASES = {
    5: ["catastroph", "famine", "system collapse", "mass casualty"],
    4: ["state of emergency", "emergency declaration", "severe", "widespread destruction"],
    3: ["significant", "critical", "major", "crisis", "large-scale"],
    2: ["elevated", "moderate", "stressed", "warning"],
}
SEVERITY_LEVELS = {"low": 1, "medium": 2, "high": 3, "critical": 4}
SOURCE_RANKS = {"social": 0, "news": 1, "humanitarian": 2, "official": 3}

# Country names and ISO 3166 codes; of names with one code the first is the code's own.
COUNTRIES = {
    "afghanistan": "AFG", "bangladesh": "BGD", "burkina faso": "BFA", "burundi": "BDI", "cameroon": "CMR", "central african republic": "CAF", "chad": "TCD", "colombia": "COL",
    "democratic republic of the congo": "COD", "drc": "COD", "dr congo": "COD", "congo": "COG", "republic of the congo": "COG", "egypt": "EGY", "eritrea": "ERI", "ethiopia": "ETH",
    "haiti": "HTI", "india": "IND", "indonesia": "IDN", "iran": "IRN", "iraq": "IRQ", "kenya": "KEN", "lebanon": "LBN", "libya": "LBY", "madagascar": "MDG", "malawi": "MWI",
    "mali": "MLI", "mauritania": "MRT", "mozambique": "MOZ", "myanmar": "MMR", "nepal": "NPL", "niger": "NER", "nigeria": "NGA", "pakistan": "PAK", "palestine": "PSE",
    "philippines": "PHL", "rwanda": "RWA", "senegal": "SEN", "sierra leone": "SLE", "somalia": "SOM", "south sudan": "SSD", "sudan": "SDN", "syria": "SYR", "tanzania": "TZA",
    "turkey": "TUR", "turkiye": "TUR", "uganda": "UGA", "ukraine": "UKR", "venezuela": "VEN", "yemen": "YEM", "zambia": "ZMB", "zimbabwe": "ZWE",
}

# Credibility tiers by connector, by domain and by kind of source; 4 is the rest.
TIER_CONNECTORS = {
    1: ["reliefweb", "ocha", "un_ocha", "unocha", "humanitarian_response"],
    2: ["government_feeds", "government", "fews", "fews_net", "care_news", "care", "icrc", "ifrc", "msf", "unicef", "unhcr", "wfp", "who", "iom", "gdacs", "usgs"],
    3: ["bbc", "reuters", "guardian", "nyt", "npr", "aljazeera", "al_jazeera", "africanews", "allafricamedia", "allafrica", "ana"],
}
TIER_DOMAINS = {
    1: ["reliefweb.int", "unocha.org", "humanitarian.response.info", "fts.unocha.org", "data.humdata.org"],
    2: ["fews.net", "care.org", "icrc.org", "ifrc.org", "msf.org", "unicef.org", "unhcr.org", "wfp.org", "who.int", "iom.int", "gdacs.org", "earthquake.usgs.gov"],
    3: ["bbc.com", "bbc.co.uk", "reuters.com", "theguardian.com", "nytimes.com", "npr.org", "aljazeera.com", "africanews.com", "allafrica.com"],
}
TIER_SOURCE_TYPES = {1: ["official", "un", "un_agency", "ingo"], 2: ["humanitarian", "government", "ngo"], 3: ["news", "media"], 4: ["social", "social_media", "blog"]}
TIER_LABELS = {1: "UN/OCHA (Tier 1)", 2: "NGO/Government (Tier 2)", 3: "Major News (Tier 3)", 4: "Other (Tier 4)"}
TIER_WEIGHTS = {1: 2.0, 2: 1.5, 3: 1.0, 4: 0.7}
CONNECTOR_WEIGHTS = {"reliefweb": 1.35, "un_humanitarian_feeds": 1.30, "government_feeds": 1.15, "ngo_feeds": 1.10, "local_news_feeds": 0.95}
HUMANITARIAN_FOCUS = ["conflict emergency", "cyclone/storm", "flood", "landslide", "heatwave", "wildfire"]
FOCUS_CONNECTORS = ["reliefweb", "un_humanitarian_feeds"]

# Media types.
MIME_DOCTYPES = {
    "application/pdf": "document_pdf", "application/x-pdf": "document_pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "document_docx", "application/msword": "document_docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "document_xlsx", "application/vnd.ms-excel": "document_xlsx",
    "text/html": "document_html", "application/xhtml+xml": "document_html",
}
EXTENSION_MIMES = {
    ".pdf": "application/pdf", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".doc": "application/msword",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", ".xls": "application/vnd.ms-excel", ".html": "text/html", ".htm": "text/html",
}

# Query parameters that only track.
TRACKING_PREFIXES = ["utm_"]
TRACKING_KEYS = ["fbclid", "gclid", "oc", "ved", "cid"]

# Policy patterns and their replacements.
INJECTION = r"(ignore\s+previous|disregard\s+previous|new\s+instructions|reveal\s+system\s+prompt|developer\s+message)"
ESCALATION = r"(exec|bash|shell|powershell|command|tool)"
SECRETS = [
    (r"sk-[a-zA-Z0-9_\-]{20,}", "[REDACTED_OPENAI_KEY]"),
    (r"ghp_[a-zA-Z0-9]{20,}", "[REDACTED_GITHUB_TOKEN]"),
    (r"(?i)(api[_-]?key\s*[=:]\s*)[^\s\"']+", "{1}[REDACTED]"),
    (r"(?i)(password\s*[=:]\s*)[^\s\"']+", "{1}[REDACTED]"),
]
SECRET_KEYS = ["password", "api_key", "apikey", "token", "secret"]
DANGEROUS_TOOLS = ["exec", "bash", "shell", "powershell", "shell_command"]
DANGEROUS_COMMANDS = [r"rm\s+-rf\s+/", r"del\s+/s\s+/q\s+c:\\", r"format\s+c:", r"shutdown\s+", r"reboot\s+", r"curl.+\|\s*(sh|bash)", r"invoke-webrequest.+\|\s*iex"]

# Sections that a report must have, each with headings that also count.
REPORT_SECTIONS = {
    "Executive Summary": ["Situation At A Glance"],
    "Incident Highlights": ["Incident Analysis", "Top Priority Updates"],
    "Source and Connector Reliability Snapshot": ["Source Reliability", "Source and Connector Reliability Assessment", "Evidence Confidence Snapshot"],
    "Risk Outlook": ["72-Hour Risk Outlook", "Forward Risk and Scenario Outlook"],
    "Method": ["Method Note", "Methodology and Scope"],
}
ANALYSIS_SECTIONS = [
    "Executive Summary", "National Impact Overview", "Province-Level", "District-Level", "Shelter", "WASH", "Health", "Food Security", "Protection", "Education",
    "Access Constraints", "Outstanding Needs", "Forecast", "Annex", "Sources and References",
]
ANALYSIS_FIGURES = ["affected", "displaced", "deaths", "injured", "missing", "houses_damaged", "houses_destroyed"]
ANALYSIS_WEIGHTS = {"section_completeness": 0.25, "key_figure_coverage": 0.20, "citation_accuracy": 0.15, "citation_density": 0.10, "admin_coverage": 0.15, "date_attribution": 0.15}
ANALYSIS_PASS = 0.55
ANALYSIS_LEAST = {"section_completeness": 0.70, "key_figure_coverage": 0.30, "citation_accuracy": 0.80, "citation_density": 0.5, "admin_coverage": 0.20, "date_attribution": 0.30}

# Headings and limits of a report, where its template says nothing else.
TEMPLATE = {
    "name": "default-v1",
    "sections": {
        "executive_summary": "Executive Summary", "incident_highlights": "Incident Highlights", "source_reliability": "Source and Connector Reliability Snapshot",
        "risk_outlook": "Risk Outlook", "method": "Method", "citations": "Citations",
    },
    "limits": {
        "max_incident_highlights": 12, "executive_summary_max_words": 180, "source_reliability_max_words": 140, "risk_outlook_max_words": 180, "method_max_words": 120,
        "incident_summary_max_words": 80, "incident_quote_max_chars": 600,
    },
}

# Feeds that every registry starts from.
DEFAULT_FEEDS = {
    "government": [
        ("USGS Earthquakes", "https://earthquake.usgs.gov/earthquakes/feed/v1.0/summary/all_day.atom"), ("GDACS All 7d", "https://www.gdacs.org/xml/rss_7d.xml"),
        ("GDACS Floods 7d", "https://www.gdacs.org/xml/rss_fl_7d.xml"), ("GDACS Cyclones 7d", "https://www.gdacs.org/xml/rss_tc_7d.xml"),
    ],
    "un": [
        ("UN News Climate", "https://news.un.org/feed/subscribe/en/news/topic/climate-change/feed/rss.xml"),
        ("UN News Humanitarian", "https://news.un.org/feed/subscribe/en/news/topic/humanitarian-aid/feed/rss.xml"),
    ],
    "ngo": [
        ("CARE News", "https://www.care.org/feed/"), ("FEWS NET Analysis Note", "https://fews.net/taxonomy/term/652/feed"),
        ("FEWS NET Weather and Agriculture Outlook", "https://fews.net/taxonomy/term/638/feed"),
    ],
    "local_news": [
        ("BBC World", "https://feeds.bbci.co.uk/news/world/rss.xml"), ("Al Jazeera English", "https://www.aljazeera.com/xml/rss/all.xml"),
        ("AllAfrica Latest", "https://allafrica.com/tools/headlines/rdf/latest/headlines.rdf"), ("Africanews", "https://www.africanews.com/feed/"),
        ("Africa News Agency (ANA)", "https://www.africannewsagency.com/feed/"), ("The Guardian World", "https://www.theguardian.com/world/rss"),
        ("Reuters World", "https://news.google.com/rss/search?q=site:reuters.com+world&hl=en-US&gl=US&ceid=US:en"),
        ("NYT World", "https://rss.nytimes.com/services/xml/rss/nyt/World.xml"), ("NPR World", "https://feeds.npr.org/1004/rss.xml"),
    ],
}


def literal_map(values: dict) -> Column:
    """A map literal, folded into the plan: the tables above are a few dozen entries each."""
    return F.create_map(*[F.lit(x) for item in values.items() for x in item])


def lookup(values: dict, key: Column) -> Column:
    """The value of ``key``, or null."""
    return F.try_element_at(literal_map(values), key)


def inverted(groups: dict) -> dict:
    """Member to group, for lookups."""
    return {member: group for group, members in groups.items() for member in members}


def feeds(spark: SparkSession) -> DataFrame:
    """(category, name, url, ord) of the default registry."""
    rows = [(category, name, url, i) for category, items in DEFAULT_FEEDS.items() for i, (name, url) in enumerate(items)]
    return spark.createDataFrame(rows, "category string, name string, url string, ord int")
