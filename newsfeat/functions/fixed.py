"""Fixed values.

Everything in this module is data that must equal the analysed script's values
for its results to be reproduced: entity names, phrase table, category rule
tables, keyword alternatives of each flag and the holiday calendar.  They are
stated as plain text in the script's own order.  Regex fragments inside a
keyword list are kept as written, except that POSIX classes are spelled the
way both Java and RE2 understand (``[[:digit:]]`` -> ``[0-9]``).

How the values are applied (pattern building, rule order, masking) lives in
``newsfeat.functions.patterns`` and ``newsfeat.operators.rules``.
"""

from __future__ import annotations

# ---------------------------------------------------------------- fixed values
# HTML entities folded to their base letter: "&" + letter + one of these + ";".
DIACRITIC_ENTITY_SUFFIXES = ["acute", "cedil", "circ", "grave", "uml"]

# HTML entities dropped from text.  In the script only the two quote entities
# carry their ";" inside the alternation, so "&mdash;", "&ndash;" and
# "&hellip;" leave a ";" behind (kept as the default, see drop_entities).
DROPPED_ENTITIES_WITHOUT_SEMICOLON = ["mdash", "ndash", "hellip"]
DROPPED_ENTITIES_WITH_SEMICOLON = ["lsquo", "rsquo"]

# Phrases joined into single tokens, applied in this order, ignoring case.
PHRASES = [
    ("new york times", "NYT"),
    ("new york city", "NYC"),
    ("new york", "NewYork"),
    ("silicon valley", "SiliconValley"),
    ("times insider", "TimesInsider"),
    ("fashion week", "FashionWeek"),
    ("white house", "WhiteHouse"),
    ("international herald tribune archive", "IHT"),
    ("president obama", "Obama"),
    ("hong kong", "HongKong"),
    ("big data", "BigData"),
    ("golden globe", "GoldenGlobe"),
]

# Blank news desk filled from the section name, in this order.
DESK_FROM_SECTION = [
    ("Arts", "Culture"),
    ("Business Day", "Business"),
    ("Health", "Science"),
    ("Multimedia", ""),
    ("N.Y. / Region", "Metro"),
    ("Open", "Technology"),
    ("Opinion", "OpEd"),
    ("Technology", "Business"),
    ("Travel", "Travel"),
    ("U.S.", "National"),
    ("World", "Foreign"),
]

# Masked updates after the desk fill: (desk condition or None, section
# condition) -> (desk, section, subsection).
PUZZLES_RULE = (None, "Crosswords/Games", ("Styles", "Puzzles", ""))
STYLE_RULE = ("Styles", "U.S.", ("Styles", "Style", ""))

# Blank section filled from the news desk, in this order.
SECTION_FROM_DESK = [
    ("Culture", "Arts"),
    ("Foreign", "World"),
    ("National", "U.S."),
    ("OpEd", "Opinion"),
    ("Science", "Science"),
    ("Sports", "Sports"),
    ("Styles", "Style"),
    ("TStyle", "Magazine"),
]

# Categories assigned by the three politics rules.
POLITICS_CATEGORIES = ("National", "U.S.", "Politics")

# Rule 1: all three categories blank and the headline starts with one of
# these (ignoring case).
POLITICS_HEADLINE_PREFIXES = [
    "first draft", "lunchtime laughs", "politics helpline", "today in politics", "verbatim",
]

# Rule 2: blank section and the text contains one of these (ignoring case).
POLITICS_TEXT_TERMS = [
    "white house", "democrat", "republican", "tea party",
    "obama", "biden", "boehner", "kerry", "capitol", "senat",
    r"sen\.", "congress", "president", "washington", "politic",
    "rubio", "palin", "clinton", "bush", "limbaugh", "rand paul",
    "christie", "mccain", "election", "poll", "cruz", "constitution",
    "amendment", "federal", "partisan", "yellen", "govern",
    r"gov\.", "legislat", "supreme court", "campaign",
    "primary", "primaries", "justice", "jury",
]

# Rule 3: blank section and the text contains one of these (case-sensitive).
POLITICS_TEXT_ACRONYMS = ["PAC", "GOP", r"G\.O\.P\.", "NRA", r"N\.R\.A\."]

MISSING_LABEL = "Missing"
UNLABELLED_DISPLAY = "N/A"

# Headline length at or below which the SEO flag is set.
SEO_MAX_CHARS = 48

# Keyword flags: (name, field, mode, ignore_case, alternatives).
# field: "Headline" or "Text"; mode: "contains", "prefix" or "word" (whole word).
FLAGS = [
    ("Question", "Headline", "contains", False, [r"\?"]),
    ("Exclamation", "Headline", "contains", False, ["!"]),
    ("HowTo", "Headline", "prefix", True, ["how to"]),
    ("Negative", "Headline", "word", True,
     ["never", "do not", "dont", "don't", "stop", "quit", "worst"]),
    ("SpecialWord", "Headline", "word", True,
     ["strange", "incredible", "epic", "simple", "ultimate", "great", "sex"]),
    ("NoComment", "Headline", "contains", True,
     ["6 q's about the news", "daily", "fashion week", "first draft", "in performance",
      "international arts events happening in the week ahead",
      "inside the times", "lunchtime laughs", "pictures of the day", "playlist",
      "podcast", r"q\. and a\.", "reading the times", "test yourself",
      "throwback thursday", "today in", "the upshot", "tune in to the times",
      "tune into the times", "under cover", "verbatim", "walkabout", "weekend reading",
      "weekly news quiz", "weekly wrap", "what we're (reading|watching)",
      "what's going on in this picture", "word of the day", "the daily gift"]),
    ("Recurrent", "Headline", "contains", True,
     ["ask well", "facts & figures", "think like a doctor", "readers respond",
      "no comment necessary", "quandary", "your turn"]),
    ("Controversial", "Headline", "word", True,
     ["gun control", "abortion", "birth control",
      "consent", "rape", "african-american", "latino", "racis(m|t)"]),
    ("Obama", "Headline", "contains", True, ["obama", "president"]),
    ("Republican", "Headline", "contains", True, ["republican"]),
    ("Congress", "Headline", "word", True, ["senate", "congress"]),
    ("Election", "Headline", "word", True, ["election", "campaign", "poll(s|)"]),
    ("Current", "Text", "contains", True,
     ["ebola", "ferguson", "michael brown", "cuba", "embargo", "castro", "havana"]),
    ("Recap", "Headline", "contains", True, ["recap"]),
    ("UN", "Text", "contains", True, [r"u\.n\.", "united nations", "ban ki-moon", "climate"]),
    ("Health", "Headline", "contains", False,
     ["mental health", "depress(a|e|i)", "anxiety", "schizo",
      "personality", "psych(i|o)", "therap(i|y)", "brain", "autis(m|t)",
      "carb", "diet", "cardio", "obes", "cancer", "homeless"]),
    ("Family", "Headline", "contains", True,
     ["education", "school", "kids", "child", "college", "teenager", "mother", "father",
      "parent", "famil(y|ies)"]),
    ("Tech", "Headline", "contains", True,
     ["twitter", "facebook", "google", "apple", "microsoft", "amazon",
      "uber", "phone", "ipad", "tablet", "kindle", "smartwatch",
      "apple watch", r"match\.com", "okcupid", "social (network|media)",
      "tweet", "mobile", " app "]),
    ("Security", "Headline", "contains", True, ["cybersecurity", "breach", "hack", "password"]),
    ("Biz", "Headline", "contains", True,
     ["merger", "acqui(s|r)", "takeover", "bid", r"i\.p\.o\.", "billion",
      "bank", "invest", "wall st", "financ", "fund", "share(s|holder)", "market",
      "stock", "cash", "money", "capital", "settlement", "econo"]),
    ("War", "Text", "contains", True,
     ["israel", "palestin", "netanyahu", "gaza", "hamas", "iran",
      "tehran", "assad", "syria", "leban(o|e)", "afghan", "iraq",
      "pakistan", "kabul", "falluja", "baghdad", "islamabad",
      "sharif", "isis", "islamic state"]),
    ("Cuba", "Text", "contains", True, ["cuba", "embargo", "castro", "havana"]),
    ("Holidays", "Text", "contains", True, ["thanksgiving", "hanukkah", "christmas", "santa"]),
    ("Boring", "Text", "contains", True,
     ["friday night music", "variety", "[0-9]{4}", "photo", "today",
      "from the week in style", "oscar", "academy", "golden globe", "diary",
      "hollywood", "red carpet", "stars", "movie", "film", "celeb", "sneak peek",
      "by the book", "video", "music", "album", "spotify", "itunes", "taylor swift",
      "veteran", "palin", "kerry", "mccain", "rubio", "rand paul", "yellen", "partisan",
      "capitol", "bush", "clinton", "senator", "congressman", "governor", "chin(a|e)",
      "taiwan", "tibet", "beijing", "hongkong", "russia", "putin"]),
]

# Holiday calendar (compared by day of year only, as in the script).
HOLIDAYS = [
    "2014-09-01", "2014-10-13", "2014-10-31", "2014-11-11",
    "2014-11-27", "2014-12-24", "2014-12-25", "2014-12-31",
]
# Publication hour from which the day before a holiday counts.
BEFORE_HOLIDAY_FROM_HOUR = 17

# Sparsity thresholds of the three term matrices, frequent-term cut-offs and
# the topic/cluster settings.
SPARSITY_HEADLINE = 0.995
SPARSITY_SUMMARY = 0.99
SPARSITY_TEXT = 0.99
FREQ_TERMS_HEADLINE_MIN = 100
FREQ_TERMS_TEXT_MIN_WEIGHT = 20
NGRAM_MIN, NGRAM_MAX = 1, 3
N_CLUSTERS = 25
N_TOPICS = 25
TOP_TERMS_PER_CLUSTER = 15
TOP_TERMS_PER_TOPIC = 5

# Model settings.
RF_TREES = 1000
RF_NODESIZE = 5
PROBABILITY_THRESHOLD = 0.5

# Columns dropped before modelling.
MODEL_DROP_COLUMNS = ["PubDate", "PubDay", "Headline", "Snippet", "Abstract",
                      "Summary", "Text", "WordCount"]
# Exclusions of the four feature forests.
RF_FULL_EXCLUDE = ["UniqueID", "Pop", "DayOfWeek", "TopicCluster", "Topic",
                   "HeadlineCharCount", "SummaryCharCount", "NumHourlyArticles"]
RF_SELECTED_EXTRA_EXCLUDE = ["Health", "Holiday", "HowTo", "Cuba", "Election"]
# Predictors of the logistic model.
LOGISTIC_PREDICTORS = [
    "NewsDesk", "SectionName", "SubsectionName", "Weekday", "LogWC",
    "HeadlineWordCount", "SummaryWordCount", "SEO", "Question", "Exclamation", "Negative",
    "SpecialWord", "NoComment", "Recurrent", "Controversial", "Obama", "Republican", "Congress",
    "BeforeHoliday", "Current", "Recap", "UN", "Family", "Tech", "Security", "Biz", "War",
    "Holidays", "Boring", "NumDailyArticles", "NumDailySectionArticles",
]
# Metadata columns appended to the bag-of-words frame.
BOW_EXTRA_COLUMNS = [
    "Popular", "NewsDesk", "SectionName", "SubsectionName", "LogWC", "Weekday", "Hour",
    "SEO", "Question", "Holiday", "BeforeHoliday", "NumDailyArticles",
    "NumDailySectionArticles", "NumHourlyArticles",
]
# Blends: name -> (model, weight) pairs; the blend is the weighted sum divided
# by the sum of the weights.  The last name says k-means forest x3 + LDA forest
# x2; as written, the script uses the LDA forest for both terms.
BLENDS = {
    "ensSelBoWLog": [("rfCustomSel", 1), ("rfBoW", 1), ("log", 1)],
    "ensKMCBoWLog": [("rfCustomSelKMC", 1), ("rfBoW", 1), ("log", 1)],
    "ensLDABoWLog": [("rfCustomSelLDA", 1), ("rfBoW", 1), ("log", 1)],
    "ens2Sel3BoW1Log": [("rfCustomSel", 2), ("rfBoW", 3), ("log", 1)],
    "ens2KMC3BoW1Log": [("rfCustomSelKMC", 2), ("rfBoW", 3), ("log", 1)],
    "ens2LDA3BoW1Log": [("rfCustomSelLDA", 2), ("rfBoW", 3), ("log", 1)],
    "ens3KMC2LDA4BoW1Log": [("rfCustomSelKMC", 3), ("rfCustomSelLDA", 2), ("rfBoW", 4), ("log", 1)],
}
BLEND_AS_WRITTEN = {
    "ens3KMC2LDA4BoW1Log_as_written": [("rfCustomSelLDA", 3), ("rfCustomSelLDA", 2), ("rfBoW", 4), ("log", 1)],
}
# Submission file naming.
SUBMISSION_PREFIX = "Submission_"
# ------------------------------------------------------------ end fixed values
