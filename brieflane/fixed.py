"""Fixed values.

Everything in this module is a constant that results depend on. The configuration
entries, templates, codes and sizes below are fixed values that must stay exactly as
written for results to match the behaviour this library reproduces. The English stop
words are Spark ML's default English list (``StopWordsRemover.loadDefaultStopWords``),
spelled out so that SQL oracles can use them without a JVM; a test checks equality.
"""

from __future__ import annotations

# --------------------------------------------------------------------------------------
# FIXED VALUES — search configuration entries (entity -> subreddits, search terms,
# companies, keywords), in their natural order.
# --------------------------------------------------------------------------------------
REFERENCE_CONFIGS: dict[str, dict[str, list[str]]] = {
    "ev commodities": {
        "subreddits": ["electricvehicles", "batteries", "commodities", "investing",
                       "stocks", "mining", "RareEarthElements", "energy",
                       "sustainability", "Lithium", "teslamotors"],
        "search_terms": ["lithium supply", "battery materials", "nickel mining",
                         "cobalt shortage", "rare earth ev", "graphite battery",
                         "copper ev demand", "battery metals", "lithium mining",
                         "ev supply chain", "battery shortage", "battery production"],
        "companies": ["ALB", "SQM", "LTHM", "LAC", "PLL", "VALE", "FCX", "MP", "GNENF", "BHP"],
        "keywords": ["lithium", "nickel", "copper", "cobalt", "graphite", "rare earth",
                     "battery materials", "battery metals", "battery supply", "mining",
                     "battery production", "battery shortage", "supply chain"],
    },
    "precious metals": {
        "subreddits": ["commodities", "investing", "stocks", "gold", "silverbugs",
                       "mining", "economy", "wallstreetsilver", "preciousmetals"],
        "search_terms": ["gold price", "silver market", "platinum demand",
                         "palladium supply", "precious metals outlook",
                         "mining production", "metal shortage", "bullion market"],
        "companies": ["NEM", "GOLD", "FNV", "WPM", "RGLD", "PAAS", "AG", "HL", "CDE", "SSRM"],
        "keywords": ["gold", "silver", "platinum", "palladium", "precious metals",
                     "mining", "bullion", "spot price", "metal production"],
    },
    "energy commodities": {
        "subreddits": ["energy", "oil", "commodities", "investing", "stocks",
                       "naturalgas", "oilandgasworkers", "renewableenergy"],
        "search_terms": ["oil price", "natural gas demand", "energy market",
                         "crude supply", "gas storage", "oil production",
                         "energy outlook", "renewable impact"],
        "companies": ["XOM", "CVX", "COP", "BP", "SHEL", "TTE", "EOG", "PXD", "OXY", "SLB"],
        "keywords": ["oil", "natural gas", "crude", "energy", "petroleum",
                     "production", "reserves", "drilling", "exploration"],
    },
    "iron": {
        "subreddits": ["stocks", "investing", "commodities", "wallstreetbets",
                       "mining", "steel", "economy", "metalworking"],
        "search_terms": ["iron ore price", "steel price", "iron mining", "iron market",
                         "steel market", "iron ore demand", "VALE earnings", "BHP iron",
                         "RIO iron"],
        "companies": ["VALE", "BHP", "RIO", "MT", "CLF"],
        "keywords": ["iron", "steel", "ore"],
    },
    "electric vehicles": {
        "subreddits": ["electricvehicles", "teslamotors", "stocks", "investing",
                       "cars", "technology", "futurology", "wallstreetbets"],
        "search_terms": ["EV market", "electric vehicle sales", "EV battery",
                         "Tesla earnings", "NIO earnings", "Rivian production",
                         "Lucid delivery", "EV charging", "EV adoption"],
        "companies": ["TSLA", "NIO", "RIVN", "LCID", "GM", "F", "XPEV", "LI"],
        "keywords": ["ev", "electric vehicle", "tesla", "charging", "battery"],
    },
}

# FIXED VALUES — generated configuration for an entity without an entry.
GENERATED_BASE_SUBREDDITS = ["commodities", "investing", "stocks", "economy",
                             "trading", "finance", "wallstreetbets"]
GENERATED_TERM_SUFFIXES = ["price", "market", "supply", "demand", "shortage",
                           "production", "outlook", "trading"]
GENERATED_COMPANIES = ["SPY"]
GENERATED_EXTRA_KEYWORDS = ["market", "price", "supply", "demand", "trading"]

# FIXED VALUES — plain-variant default configuration for an entity without an entry:
# subreddits below, search terms [entity], companies [], keywords [lower(entity)].
PLAIN_DEFAULT_SUBREDDITS = ["stocks", "investing", "news", "worldnews"]

# FIXED VALUES — default ticker when an entity has no companies.
DEFAULT_SYMBOL = "SPY"

# FIXED VALUES — timeframe code -> forum time window; anything else -> "week".
TIMEFRAME_WINDOWS = {"1d": "day", "1w": "week", "1mo": "month", "3mo": "year", "1y": "year"}
DEFAULT_TIMEFRAME_WINDOW = "week"

# FIXED VALUES — time window -> days before the anchor; anything else -> 7 days.
WINDOW_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}
DEFAULT_WINDOW_DAYS = 7

# FIXED VALUES — boolean news query for the entity "iron" (conjunction of disjunctions),
# every other entity searches for its own name.
IRON_NEWS_QUERY = [["iron ore", "steel"], ["price", "market", "demand", "mining"]]

# FIXED VALUES — result sizes.
POSTS_PER_REQUEST_PLAIN = 10
ARTICLES_PER_ENTITY = 100  # what one news search returns, for callers who cap
VIDEOS_PER_ENTITY = 10     # what one video search returns
TOP_POSTS = 10
RECENT_NEWS = 5
TOP_VIDEOS = 5
TOP_SUBREDDITS = 5
TRANSCRIPT_SUMMARY_CHARS = 500

# FIXED VALUES — report texts.
NO_REDDIT = "No Reddit data available"
NO_NEWS = "No news data available"
NO_YOUTUBE = "No YouTube data available"
NO_TRANSCRIPT = "No transcript available"
ERROR_PREFIX = "Error performing sentiment analysis. Raw data is provided below:"
MARKET_NOTE = "Note: This data represents real-time market information."
MISSING_PRICE = "Missing price data"
MALFORMED_RESPONSE = "Malformed response"

# FIXED VALUES — Spark ML default English stop words (181), natural order.
ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours",
    "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers",
    "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves",
    "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does",
    "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until",
    "while", "of", "at", "by", "for", "with", "about", "against", "between", "into",
    "through", "during", "before", "after", "above", "below", "to", "from", "up", "down",
    "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here",
    "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
    "i'll", "you'll", "he'll", "she'll", "we'll", "they'll", "i'd", "you'd", "he'd",
    "she'd", "we'd", "they'd", "i'm", "you're", "he's", "she's", "it's", "we're",
    "they're", "i've", "we've", "you've", "they've", "isn't", "aren't", "wasn't",
    "weren't", "haven't", "hasn't", "hadn't", "don't", "doesn't", "didn't", "won't",
    "wouldn't", "shan't", "shouldn't", "mustn't", "can't", "couldn't", "cannot", "could",
    "here's", "how's", "let's", "ought", "that's", "there's", "what's", "when's",
    "where's", "who's", "why's", "would",
]

# FIXED VALUES — brief instructions handed to an external model with each entity brief.
BRIEF_INSTRUCTIONS = [
    "Provide a comprehensive analysis including:",
    "1. Overall Sentiment",
    "2. Key Trends and Patterns",
    "3. Main Concerns or Opportunities",
    "4. Confidence Level in the Analysis",
    "Consider insights from all three sources (Reddit, News, YouTube) in your analysis.",
    "Format the response in a clear, structured way.",
]
BRIEF_HEAD = "Analyze the following market data for "
BRIEF_SECTIONS = ["Reddit Discussion:", "Recent News:", "YouTube Content:"]

# FIXED VALUES — the plain brief and its instructions.
PLAIN_BRIEF_HEAD = "Analyze the following data about "
PLAIN_BRIEF_INSTRUCTIONS = [
    "Provide a concise analysis with:",
    "1. Overall sentiment (positive/negative/neutral)",
    "2. Key trends and patterns",
    "3. Main concerns or opportunities",
    "4. Market outlook and price trends (if available)",
    "5. Confidence level in the analysis",
    "",
    "Note: Some data sources might be unavailable. Focus on analyzing the available data.",
    "If limited data is available, acknowledge this in your confidence level.",
    "For iron specifically, consider both iron ore prices and steel market conditions.",
    "Consider the credibility and relevance of each source when forming your analysis.",
]

# FIXED VALUES — report lines, sections and texts for missing fields.
POST_LINE = "- [%s] %s (Score: %d, Comments: %d, Search term: %s)"
NEWS_LINE = "- %s (Source: %s)"
NEWS_LINE_PLAIN = "- %s: %s"
VIDEO_LINE = "- %s (Channel: %s, Views: %d)"
NO_TITLE = "No title"
UNKNOWN = "Unknown"
POSTS_SECTION = "Reddit Posts:"
NEWS_SECTION = "News Articles:"
NO_DATA_ERROR = "No data available from either Reddit or News API"
