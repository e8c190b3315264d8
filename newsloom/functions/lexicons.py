"""Word lists, patterns and thresholds that results depend on."""

# Words of the sensationalism score.
EMOTIONAL = (
    "shocking", "terrifying", "horrifying", "devastating", "explosive", "bombshell", "outrage", "fury", "chaos", "crisis", "panic", "nightmare",
    "catastrophe", "catastrophic", "disastrous", "dire", "alarming", "staggering", "jaw-dropping", "mind-blowing", "insane", "unbelievable",
    "incredible", "outrageous", "scandalous", "slam", "slams", "blasts", "rips", "destroys", "eviscerate", "demolish", "skyrocket", "plummet",
    "freefall", "collapse", "meltdown", "erupts", "rages", "firestorm", "backlash", "uproar",
)
ABSOLUTE = (
    "always", "never", "everyone", "nobody", "nothing", "everything", "completely", "totally", "absolutely", "entirely", "utterly", "all", "none",
    "worst", "best", "ever",
)
LOADED = (
    "massive", "huge", "enormous", "tiny", "pathetic", "laughable", "brilliant", "genius", "stupid", "idiotic", "radical", "extreme", "unprecedented",
    "historic", "groundbreaking", "revolutionary",
)
BAIT = (
    r"\?$",
    r"^(will|could|should|is|are|does|did|has|can|would)\s",
    r"you won't believe",
    r"here's why",
    r"what you need to know",
    r"the truth about",
    r"this is (what|why|how)",
)

# Replacements in neutral headlines.
NEUTRAL = (
    (r"\bslams?\b", "criticizes"),
    (r"\bblasts?\b", "criticizes"),
    (r"\brips?\b", "criticizes"),
    (r"\bdestroys?\b", "challenges"),
    (r"\bskyrockets?\b", "rises sharply"),
    (r"\bplummets?\b", "declines sharply"),
    (r"\bfreefall\b", "decline"),
    (r"\bchaos\b", "disruption"),
    (r"\berupts?\b", "emerges"),
    (r"\bmeltdown\b", "decline"),
    (r"\bshock\b", "impact"),
    (r"\bstunning\b", "notable"),
    (r"\bbombshell\b", "development"),
)

# Emoji, labels, show names and dates that neutral headlines lose.
EMOJI = r"[\x{1F300}-\x{1F9FF}\x{1FA00}-\x{1FAFF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}\x{FE00}-\x{FE0F}\x{200D}]+"
HEADLINE_LABELS = (r"^(BREAKING|JUST IN|EXCLUSIVE|URGENT|ALERT|WATCH|LISTEN):\s*", r"^You won't believe:?\s*", r"^\[.*?\]\s*", r"^\s*")
HEADLINE_DATES = (r"\s*\|\s*[\p{L}\p{N}_\s]+\d{2}/\d{2}/\d{2,4}\s*$", r"\s+\d{2}/\d{2}/\d{2,4}\s*$")

# What separates the parts of a publisher's name, and what it may end in.
PUBLISHER_SEPARATORS = (" - ", " -- ", " | ", ": ")
PUBLISHER_ENDING = r" (?:RSS|Feed|rss|feed)$"

# Words that count for nothing when headlines are compared.
HEADLINE_STOPWORDS = (
    "the", "a", "an", "in", "on", "at", "to", "for", "of", "is", "as", "and", "or", "but", "by", "with", "from", "its", "has", "have", "had", "are",
    "was", "were", "be", "been", "will", "it", "that", "this", "s", "after", "over", "about", "into", "than", "not", "no", "so", "up", "out", "just",
    "how", "what", "when", "where", "who", "why", "which", "could", "would", "should", "may", "might", "can", "do", "does", "did", "new", "says",
    "said", "following", "amid", "during", "between",
)

# Words that count for nothing when a market question is matched to events.
QUESTION_STOPWORDS = (
    "will", "the", "and", "for", "that", "this", "with", "from", "have", "been", "are", "was", "were", "not", "but", "what", "before", "after",
    "about", "into", "than", "more", "most", "win", "over", "under", "end", "year", "next", "any", "may", "one", "two", "new", "can", "how", "who",
    "when", "where", "which", "does", "did", "its", "all", "would", "could", "should", "between", "during", "through", "hit", "by",
)

# Parameters dropped from links.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "source", "mc_cid", "mc_eid",
)

# Chrome removed from article bodies.
BOILERPLATE = (
    r"Share this article.*?(?:\n|$)",
    r"Follow us on.*?(?:\n|$)",
    r"Subscribe to.*?(?:\n|$)",
    r"Sign up for.*?(?:\n|$)",
    r"Related articles?:.*?(?:\n|$)",
    r"Read more:.*?(?:\n|$)",
    r"Click here to.*?(?:\n|$)",
    r"Advertisement\s*",
    r"Sponsored content\s*",
    r"©\s*\d{4}.*?(?:\n|$)",
    r"All rights reserved.*?(?:\n|$)",
)

# Elements that hold no article text.
NON_CONTENT = ("script", "style", "nav", "header", "footer", "aside", "iframe", "noscript", "svg", "form")

# The HTML entities that the queries' SQL decodes; the functions decode all.
HTML_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))

# Keywords of the impact score, and titles that are digests and no events.
IMPACT_KEYWORDS = (
    "federal reserve", "rate cut", "rate hike", "inflation", "gdp", "earnings", "ipo", "acquisition", "merger", "bankruptcy", "sanctions", "tariff",
    "regulation", "indictment", "resign", "crash", "rally", "recession", "war", "ceasefire", "election", "breaking", "urgent", "ai act", "antitrust", "sec ",
    "layoff", "hack", "breach", "default", "downgrade", "upgrade", "coup", "assassination", "pandemic", "earthquake", "hurricane", "trillion", "billion",
    "executive order", "supreme court",
)
DIGEST_TITLES = (
    "here's what you need to know", "here is an early look", "front page of the", "get up to speed", "just published:", "today's briefing", "daily dose of",
    "here's the latest", "here are the major earnings", "latest news and analysis on", "start your day", "what's moving global markets",
)

# Keywords by topic, in the order that breaks ties.
TOPICS = {
    "Economy": (
        "fed", "federal reserve", "gdp", "inflation", "interest rate", "stock", "market", "bitcoin", "etf", "trade", "tariff", "economy", "fiscal", "monetary", "bank", "currency",
        "bond", "oil", "crude", "barrel", "energy price", "fuel", "earnings", "revenue", "ipo", "investor", "dividend", "s&p", "dow", "nasdaq", "wage", "employment", "recession",
        "rate hike", "rate cut", "treasury", "debt", "deficit", "budget", "tax", "profit", "loss", "commodity", "gold", "silver", "copper", "wheat", "corn", "natural gas", "opec",
        "supply chain", "retail", "housing", "mortgage", "real estate", "cpi", "ppi", "jobs report", "payroll", "unemployment", "central bank", "hedge fund", "private equity", "venture capital",
    ),
    "Technology": (
        "ai", "artificial intelligence", "chip", "semiconductor", "software", "data breach", "cyber", "spacex", "battery", "ev", "tech", "robot", "quantum", "algorithm", "startup", "app",
        "cloud", "saas", "internet", "social media", "streaming", "5g", "autonomous", "blockchain", "crypto", "nft", "metaverse", "virtual reality", "augmented reality", "drone",
        "satellite", "telecom", "apple", "google", "microsoft", "amazon", "meta", "nvidia", "tesla", "openai", "anthropic",
    ),
    "Politics": (
        "election", "congress", "senate", "parliament", "president", "minister", "treaty", "vote", "legislation", "policy", "diplomatic", "sanction", "war", "military", "strike", "conflict",
        "iran", "ceasefire", "nato", "united nations", "protest", "coup", "rebel", "terror", "refugee", "immigration", "border", "democrat", "republican", "prime minister", "governor",
        "mayor", "cabinet", "diplomacy", "embassy", "nuclear", "weapon", "army", "navy", "air force", "invasion", "occupation", "liberation", "geopolitics",
    ),
    "Health": (
        "vaccine", "disease", "health", "hospital", "medical", "patient", "pharma", "drug", "clinical", "pandemic", "epidemic", "virus", "cancer", "surgery", "treatment", "therapy", "fda",
        "who", "mental health", "diagnosis", "outbreak", "infection", "mortality", "public health",
    ),
    "Environment": (
        "climate", "wildfire", "hurricane", "earthquake", "flood", "emission", "carbon", "environmental", "renewable", "solar", "wind energy", "drought", "tsunami", "tornado", "volcano",
        "deforestation", "pollution", "biodiversity", "species", "ocean", "glacier", "temperature", "weather", "storm", "cyclone", "typhoon", "el nino", "la nina", "sea level",
    ),
}
GEOGRAPHIES = {
    "US": ("united states", "u.s.", "us ", "washington", "california", "new york", "texas", "arizona", "congress", "senate", "federal reserve", "fda", "sec"),
    "Europe": ("eu", "european", "brussels", "london", "berlin", "paris", "uk", "britain", "germany", "france", "european parliament"),
    "Asia": ("china", "japan", "india", "tokyo", "beijing", "seoul", "korea", "taiwan", "tsmc", "toyota", "singapore"),
    "Global": ("global", "world", "international", "united nations", "who", "worldwide", "g20", "g7"),
}

# Word stems that contradict each other in claims.
ANTONYMS = (
    ("increase", "decrease"), ("rise", "fall"), ("gain", "loss"), ("up", "down"), ("growth", "decline"), ("approve", "reject"), ("confirm", "deny"),
    ("support", "oppose"), ("pass", "fail"), ("accelerat", "decelerat"), ("improv", "worsen"),
)

# Keywords of the AI feed, hype phrases, and terms of the relevance rules.
AI_KEYWORDS = (
    "artificial intelligence", "machine learning", "deep learning", "neural network", "large language model", "LLM", "generative AI", "gen AI", "OpenAI", "Anthropic", "DeepMind",
    "Google AI", "Meta AI", "Microsoft AI", "xAI", "Mistral AI", "Stability AI", "Hugging Face", "ChatGPT", "GPT-4", "GPT-5", "Claude AI", "LLaMA", "GitHub Copilot", "AI chip",
    "AI data center", "Google TPU", "nuclear power AI", "energy AI", "power consumption AI", "open source AI", "open-source model", "open weight", "AI regulation", "AI safety",
    "AI policy", "AI governance", "AI robot", "humanoid robot", "autonomous vehicle AI",
)
AI_HYPE = ("will destroy", "will replace all", "end of humanity", "singularity is here", "terrifying", "mind-blowing", "you won't believe")
AI_STRONG = (
    "artificial intelligence", "machine learning", "deep learning", "neural network", "large language model", "generative ai", "gen ai", "ai model", "ai system", "ai safety",
    "ai regulation", "ai policy", "ai governance", "ai chip", "chatgpt", "gpt-4", "gpt-5", "llama", "ai startup", "ai company", "ai training", "ai inference", "ai agent",
    "ai assistant", "text-to-image", "text-to-video", "ai-generated", "ai-powered",
)
AI_COMPANIES = ("openai", "anthropic", "deepmind", "hugging face", "huggingface", "stability ai", "cohere", "mistral ai")
AI_PRODUCTS = ("chatgpt", "gpt-4", "gpt-5", "github copilot")
AI_CONTEXT = ("model", "training", "data", "algorithm", "robot", "automat", "compute", "gpu", "inference", "deploy", "tech", "startup", "regulation", "bias", "ethics", "research", "lab")

# Capitalised words that name nothing.  Another list can be passed to the extractor.
ENTITY_STOPWORDS = (
    "The", "This", "That", "These", "Those", "Here", "There", "When", "Where", "What", "Which", "Who", "How", "Why", "Its", "Their", "Some", "Many", "Most", "Each", "Every", "Both", "Such",
    "Other", "And", "But", "Or", "Not", "Nor", "For", "So", "If", "As", "At", "By", "To", "In", "On", "Of", "Up", "No", "An", "With",
    "Just", "Also", "Still", "Even", "More", "Less", "Much", "Very", "Only", "Already", "Again", "Yet", "Now", "Then", "Well", "About", "After", "Before", "Between", "During", "Since", "Until",
    "While", "Hold", "Apart", "According", "However", "Meanwhile", "Furthermore", "Moreover", "Nevertheless", "Although", "Despite", "Related", "High", "Low", "New", "Old", "Big", "Top", "Read",
    "Watch", "Click", "Sign", "View", "Share", "Open", "Close", "Free", "Live", "Breaking", "Update", "Report", "Source", "Sources", "Photo", "Video", "Image", "Audio", "Exclusive", "Opinion",
    "Analysis", "Editorial", "Repo", "Companies", "Workers", "People", "Markets", "Stocks", "Shares",
    "Eventually", "Importantly", "Therefore", "Because", "Elsewhere", "Considering", "Especially", "Additionally", "Consequently", "Regardless", "Apparently", "Presumably", "Certainly",
    "Essentially", "Generally", "Recently", "Previously", "Currently", "Initially", "Finally", "Says", "Said", "Gets", "Got", "Has", "Had", "Was", "Were", "Are", "Been", "Being", "Having", "Does",
    "Did", "Make", "Made", "Take", "Took", "Give", "Gave", "Come", "Came", "Goes", "Gone", "Went",
    "Fears", "Hundreds", "Thousands", "Millions", "Billions", "Heavy", "Several", "Various", "Potential", "Possible", "Likely", "Unlikely", "Major", "Minor", "Significant", "Critical", "Key",
    "Really", "Quite", "Rather", "Fairly", "Nearly", "Almost", "Whats", "Heres", "Thats",
    "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December",
    "See", "Will", "Hike", "Spike", "Hit", "Rise", "Fall", "Drop", "Jump", "Surge", "Slide", "Slip", "Gain", "Lose", "Cut", "Set", "Prices", "Rates", "Over", "Under", "Lower", "Higher",
    "Highest", "Lowest", "Trending", "Topics", "Searches", "Recent", "Latest",
    "RSS", "API", "URL", "HTTP", "HTTPS", "HTML", "CSS", "PDF", "FAQ", "EST", "PST", "GMT", "UTC", "ETF", "IPO", "CEO", "CFO", "COO",
)

# Left parts of a publisher's name that say nothing, and titles by which a question is recognised.
GENERIC_PUBLISHERS = ("news", "latest articles", "rss feed", "feed", "all releases", "press release", "press releases", "top stories", "headlines")
QUESTION_STARTS = ("how ", "why ", "what ", "anyone ", "does ", "is it ", "can you ", "should ")

# Seconds of the named time ranges.
TIME_RANGES = {"1h": 3600, "6h": 21600, "24h": 86400, "7d": 604800}

# Subjects of market questions, in order.
MARKET_CATEGORIES = (
    ("Crypto", "bitcoin|ethereum|crypto|btc|eth|solana|defi"),
    ("Politics", "president|election|congress|senate|trump|biden|governor|political|legislation|impeach"),
    ("Macro", "fed|inflation|gdp|recession|interest rate|cpi|treasury|tariff|trade war|macro"),
    ("Sports", "nfl|nba|mlb|soccer|football|tennis|sport|championship|super bowl"),
    ("Tech", "ai |artificial|openai|google|apple|microsoft|tech|chip|semiconductor"),
)
