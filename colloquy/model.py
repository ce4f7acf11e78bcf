"""Fixed values, schemas and thresholds of the discourse model."""

from __future__ import annotations

from pyspark.sql import types as T

# Categories of sources, in order.
CATEGORIES = ["social", "news", "academic", "policy", "nonprofit", "developer", "blog"]

# Kinds of sources, and the collection queue of each kind that has one.
SOURCE_TYPES = ["rss", "api", "reddit", "scrape"]
QUEUE_OF_TYPE = {"reddit": "collect.reddit", "rss": "collect.rss", "arxiv": "collect.arxiv", "scraper": "collect.scraper"}

# Indicators of sentiment, in the order that decides ties.
INDICATORS = ["positive", "neutral", "negative"]

# The 20 relevance keywords, matched as substrings.
RELEVANCE_KEYWORDS = [
    "artificial intelligence", "machine learning", "deep learning", "neural network", "large language model",
    "llm", "natural language processing", "nlp", "transformer", "reinforcement learning",
    "generative ai", "computer vision", "foundation model", "fine-tuning", "embeddings",
    "gpt", "bert", "diffusion model", "autonomous agent", "ai safety",
]

# The markers of the four lexical dimensions of deliberative quality, matched as substrings.
JUSTIFICATION_MARKERS = ["because", "therefore", "since", "thus", "hence", "consequently", "as a result", "it follows that", "given that", "for this reason", "in order to", "due to"]
HOSTILE_MARKERS = ["stupid", "idiot", "garbage", "worthless", "moron", "dumb", "pathetic", "useless", "hate", "awful", "terrible person", "shut up", "go away"]
CONSTRUCTIVE_MARKERS = ["should", "could", "would", "propose", "suggest", "recommend", "solution", "approach", "improve", "address", "invest", "build", "implement", "develop", "constructive"]
EVIDENCE_MARKERS = ["according to", "research shows", "studies show", "study", "research", "evidence", "data", "findings", "survey", "experiment", "paper", "published", "report", "statistics", "analysis indicates"]
DIMENSIONS = ["participation", "justification", "respectfulness", "constructiveness", "evidence"]

# Keys of a raw payload that identify a person.
PII_KEYS = ["author", "author_fullname", "username", "user", "email"]

# Known cities with latitude and longitude.
CITY_COORDINATES = {
    "San Francisco": (37.7749, -122.4194), "New York": (40.7128, -74.0060), "London": (51.5074, -0.1278), "Tokyo": (35.6762, 139.6503),
    "Berlin": (52.5200, 13.4050), "Paris": (48.8566, 2.3522), "Seoul": (37.5665, 126.9780), "Beijing": (39.9042, 116.4074),
    "Shanghai": (31.2304, 121.4737), "Bangalore": (12.9716, 77.5946), "Mumbai": (19.0760, 72.8777), "Sydney": (-33.8688, 151.2093),
    "Toronto": (43.6532, -79.3832), "Vancouver": (49.2827, -123.1207), "Amsterdam": (52.3676, 4.9041), "Stockholm": (59.3293, 18.0686),
    "Singapore": (1.3521, 103.8198), "Zurich": (47.3769, 8.5417), "Tel Aviv": (32.0853, 34.7818), "Chicago": (41.8781, -87.6298),
    "Los Angeles": (34.0522, -118.2437), "Seattle": (47.6062, -122.3321), "Boston": (42.3601, -71.0589), "Austin": (30.2672, -97.7431),
    "Lagos": (6.5244, 3.3792), "Nairobi": (-1.2921, 36.8219), "São Paulo": (-23.5505, -46.6333), "Buenos Aires": (-34.6037, -58.3816),
    "Cairo": (30.0444, 31.2357), "Moscow": (55.7558, 37.6173), "Dublin": (53.3498, -6.2603), "Jakarta": (-6.2088, 106.8456),
}

# Our own small valence lexicon; the scorer takes any other.
LEXICON = {
    "good": 3, "great": 3, "excellent": 4, "benefit": 2, "hope": 2, "helpful": 2, "trust": 1, "progress": 2, "safe": 1, "love": 3, "win": 4, "useful": 2,
    "bad": -3, "terrible": -4, "harm": -2, "fear": -2, "risk": -2, "biased": -2, "fraud": -4, "worthless": -2, "stupid": -2, "hate": -3, "fail": -2, "worried": -3,
}

# Thresholds.
POSITIVE_ABOVE, NEGATIVE_BELOW = 0.05, -0.05
WARM_FROM, BUCKET_ABOVE = 0.1, 0.1
GATE_RELEVANCE, GATE_CONFIDENCE = 0.40, 0.85
WORDS_FULL, WORDS_PARTIAL = 50, 15
LOCATION_MAX, LOCATION_CRITICAL, PARITY_MAX, DOMINANCE_MAX = 0.60, 0.80, 0.30, 0.70
PARITY_GAP_WARNING, PARITY_GAP_CRITICAL, ODDS_GAP, SOURCE_MAX = 0.10, 0.20, 0.08, 0.40
NOVEL_ABOVE, ECHO_BELOW = 0.40, 0.15
MIN_TOTAL, DIVIDE_MIN_SHARE, MIN_THEME_VOLUME = 5, 0.08, 3
BAR_WIDTH, BAR_DEPTH, BAR_GAP, BAR_TOP, BAR_FLOOR, SEGMENT_FLOOR = 0.15, 0.10, 0.05, 500_000, 5_000, 2_000
RETENTION_DAYS = 90

# Registered scoring methods; null deprecated_at means in force.
METHODOLOGIES = [
    ("sentiment", "1.0.0", "lexicon-valence-v1", '{"positive_threshold":0.05,"negative_threshold":-0.05}', "2024-01-01", None),
    ("relevance", "1.0.0", "keyword-relevance-v1", '{"keywords":20,"threshold":0}', "2024-01-01", None),
    ("discourse", "1.0.0-DQI", "dqi-heuristic-v1", '{"dimensions":5}', "2024-01-01", None),
    ("sentiment", "0.9.0", "lexicon-valence-v0", '{"positive_threshold":0.1,"negative_threshold":-0.1}', "2023-06-01", "2024-01-01"),
    ("bias", "1.0.0", "distribution-checks-v1", '{"location_concentration_max":0.6,"platform_parity_max_diff":0.3,"negative_dominance_max":0.7}', "2024-01-01", None),
]

#: Why each method decides as it does, in plain words.
JUSTIFICATIONS = {
    "sentiment": "The values of known words are added up and divided by the number of words.",
    "relevance": "A post is relevant if it holds one of the listed keywords.",
    "discourse": "Five signs of deliberation are scored from 0 to 1 and averaged.",
    "bias": "Shares and means of groups of posts are held against fixed limits.",
}

POSTS = T.StructType(
    [
        T.StructField("post_id", T.LongType()),
        T.StructField("source_name", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("external_id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("collected_at", T.TimestampNTZType()),
        T.StructField("job_id", T.LongType()),
    ]
)
