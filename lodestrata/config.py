"""Defaults in one place. Every operator takes its values as parameters; these are what it uses if given none."""

# Sizes and thresholds that results depend on.
CHUNK_SIZE, CHUNK_OVERLAP, CHUNK_MIN = 1800, 250, 100
BLURB_MIN, BLURB_MAX = 40, 3000
NAMES_PER_CHUNK = 6
RELEVANCE_MIN_WORDS, RELEVANCE_MIN_SCORE = 25, 2
BAND_LOW, BAND_HIGH = 100, 4000
REVENUE_FLOOR_M, REVENUE_MAX_AGE = 25.0, 1
LARGE_FOOTPRINT_M2 = 10_000.0
CATCHMENT_KM, SAME_PLACE_KM = 50.0, 12.0
MATCH_RADIUS_M, UNNAMED_RADIUS_M = 40.0, 15.0
BLOCK_TOP_N = 10
WEIGHTS = {"name": 0.353, "embedding": 0.353, "location": 0.0, "founded_year": 0.118, "founders": 0.176}
STRONG, ANOMALY_GAP, REVIEW_THRESHOLD = 0.80, 0.30, 0.55
OVERLAP_VETO, OVERLAP_NAME_CEILING = 0.05, 0.5
FUZZY_THRESHOLD, SAME_CITY_THRESHOLD, OTHER_CITY_THRESHOLD = 88.0, 80.0, 95.0
TRIVIAL_REWORD, LENGTH_MARGIN = 90.0, 1.20
TIERS = [(81, "PRIORITY"), (61, "HIGH_QUALITY_LEAD"), (41, "INTERESTING"), (21, "EARLY_DISCOVERY"), (0, "WEAK_SIGNAL")]
SOURCE_SCORE = {"accelerator": 20, "incubator": 20, "university_hub": 20, "startup_network": 12, "intelligence_platform": 12, "newsletter": 8, "rss": 4, "general": 4}
SOURCE_CONFIDENCE = {"accelerator": 45, "incubator": 45, "university_hub": 45, "startup_network": 30, "intelligence_platform": 30, "newsletter": 20, "rss": 10, "general": 10}
DIVERSITY_BONUS, CONFIDENCE_BONUS = [0, 0, 6, 10, 15], [0, 0, 15, 25, 30]
NOTABLE_SOURCES = ["sheet", "wikidata", "wikipedia", "manual", "search"]
RECALL_LOW, RECALL_GAP = 0.6, 5
BURST_MIN, BURST_SHARE = 15, 0.6
ENRICH_MINUTES = 2.3

# Legal forms that carry no identity, in two lists for two uses.
LEGAL_FORMS = "gmbh ag ug kg ohg kgaa gbr ev inc llc ltd bv sas sarl sl ab oy as se plc corp co srl spa nv sa pte pvt".split()
LEGAL_FORM_PATTERNS = ["gmbh", "mbh", "ag", "se", "kg", "ohg", r"e\.?\s?k\.?", r"e\.?\s?v\.?", "ug", r"co\.?", "kgaa", "holding", "gruppe", "group", "deutschland"]
# Hosts that many organisations share.
SHARED_DOMAINS = "linkedin.com twitter.com x.com facebook.com instagram.com medium.com substack.com beehiiv.com notion.site notion.so github.io github.com webflow.io linktr.ee youtube.com crunchbase.com angel.co wefunder.com eu-startups.com gmail.com google.com".split()
# Stopwords of the two languages that are told apart, and place names that mean the same.
STOPWORDS_DE = "der die das und für fur mit von zu ist sind eine einen einer unternehmen wir auf im sich durch werden wird auch bei als aus nicht".split()
STOPWORDS_EN = "the and for with of to is are a an company we on in by provides offers that as its their was were this".split()
SYNONYMS = {"deutschland": "germany", "muenchen": "munich", "munchen": "munich", "koeln": "cologne", "koln": "cologne", "wien": "vienna", "zuerich": "zurich"}
# Signals that must stand near a founding year, and those of an amount or a headcount.
YEAR_SIGNALS = ["founded", "founded in", "co-founded", "established", "est.", "incorporated", "started in", "launched in", "since", "gegründet", "gegr.", "seit"]
YEAR_CONTEXT = 60
EMPLOYEE_SIGNALS = ["employee", "employees", "headcount", "staff", "fte", "team of", "person team", "people on the team", "headcount of", "mitarbeiter", "beschäftigte", "belegschaft", "mann team", "köpfe"]
AMOUNT_SIGNALS = ["million", "mio", "billion", "bn", "thousand", "tsd", "€", "$", "usd", "eur", "dollar", "euro", "funding", "raised", "investment", "eingesammelt", "finanzierung", "kapital", "runde"]
# Texts of images that name nothing.
ALT_NOISE = "logo icon image bild foto photo picture banner avatar placeholder default".split()
# What frames a page, what its elements' classes call a name, and texts of buttons that show more.
CHROME_TAGS = ["nav", "footer", "header", "aside"]
CHROME_HINTS = r"(?i)(?:^|[-_\s])(?:nav|menu|footer|header|breadcrumb|social|partner|sponsor|cookie|banner)"
NAME_CLASS_HINTS = "(?i)(title|name|heading|label|company)"
LOAD_MORE = ["Mehr laden", "Mehr anzeigen", "Weitere laden", "Mehr Ergebnisse", "Alle anzeigen", "Load more", "Show more", "See more", "View more"]
COUNT_TEXT = r"(?i)\b(\d{2,4})\s+(startups?|companies|unternehmen|firmen|portfolio|mitglieder|members)\b"
EDITORIAL = "event events veranstaltung veranstaltungen termine termin news neuigkeiten blog article articles artikel post posts presse press magazin magazine stories story aktuelles jobs karriere career careers kurse webinar".split()
CARD_LEAST, CARD_THRESHOLD, NAME_ONLY, PROSE_LINKS = 4, 0.55, (24, 0.8), 0.45
CARD_WEIGHTS = {"identity": 0.30, "linked": 0.20, "heading": 0.15, "alike": 0.15, "size": 0.10, "image": 0.10, "chrome_cap": 0.15, "empty": 0.30}
# Elements that begin a new block of text, and how blocks of a page make up an article (points, shares, blocks).
HEADING_TAGS = "h1 h2 h3 h4 h5 h6".split()
BLOCK_TAGS = [*HEADING_TAGS, *"address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form header hr li main nav ol p pre section table td th title tr ul".split()]
COLUMN_GAP, COLUMN_OVERLAP, BLOCK_SLACK = 22.0, 0.3, 2.0
REGION_REACH, REGION_PADDING = 6, 12.0
# Hosts that report on organisations, and parts of the hosts of directories, networks and job boards.
REPORTING_DOMAINS = "pitchbook.com tracxn.com dealroom.co wikipedia.org techcrunch.com sifted.eu tech.eu wellfound.com startupticker.ch munich-startup.de gruenderszene.de".split()
DIRECTORY_HOSTS = "linkedin. xing. facebook. instagram. twitter. x.com youtube. wikipedia. wikidata. crunchbase. northdata. kununu. indeed. stepstone. glassdoor. dnb.com companyhouse. firmenwissen. wer-zu-wem. openstreetmap. google. bing. yelp. gelbeseiten. dasoertliche.".split()
