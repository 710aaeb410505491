"""Fixed values that must agree with recorded results."""

#: Markers of pain, of intent to buy and of complexity; substrings of lower-cased text.
PAIN_MARKERS = (
    "wish", "hate", "hated", "broken", "broke", "breaks", "fell apart", "falling apart", "cheaply", "flimsy", "poor quality", "junk", "garbage",
    "useless", "worst", "terrible", "awful", "annoying", "frustrating", "frustrated", "disappointing", "regret", "doesn't work", "does not work",
    "stopped working", "stopped charging", "failed after", "refund", "returned it", "return policy", "waste of money", "overpriced", "ripped off",
    "scam", "recall", "defective", "leak", "leaks", "leaking", "cracked", "rust", "peeled", "wore out", "worn out", "won't stay", "won't hold",
    "can't find", "never lasts", "only lasted", "lasted a month", "lasted two", "no longer works", "problem with", "issue with", "issues with", "anyone else having",
)
INTENT_MARKERS = (
    "looking for", "i need", "need a", "need an", "where to buy", "where can i buy", "best", "recommend", "recommendations", "which one",
    "what do you use", "anyone know", "alternative", "alternatives", "replacement", "upgrade", "worth it", "should i buy", "in search of", "iso",
    "help me find", "is there a", "wish there was", "would buy", "take my money",
)
COMPLEXITY_MARKERS = (
    "app", "bluetooth", "wifi", "wireless", "sensor", "battery", "rechargeable", "ai", "camera", "microcontroller", "firmware", "cloud",
    "subscription", "solar", "motor", "heater", "pump", "laser",
)
#: Metric and metadata names that count as talk.
ENGAGEMENT_KEYS = ("comments", "num_comments", "replies", "upvotes", "likes", "score", "favorites", "reblogs", "descendants")
#: Terms that make a product hard to ship.
PENALTIES = ("patent", "regulated", "fda", "medical device", "prescription", "hazmat", "lithium battery", "firearm", "licensed", "insurance", "warranty claim")

#: Weights by version, in the order demand, gap, pain, money, feasibility, interest.
WEIGHTS = {"v1": (0.30, 0.25, 0.20, 0.15, 0.10, 0.0), "v2": (0.20, 0.20, 0.15, 0.10, 0.10, 0.25)}
#: How the halves of a sub-score are blended.
BLEND = {"dv": (0.6, 0.4), "ss": (0.7, 0.3), "sp": (0.6, 0.4), "mp": (0.5, 0.5)}
PRICE_LOW, PRICE_HIGH = 10.0, 400.0
PER_PENALTY, PER_COMPLEXITY, FEASIBILITY_FLOOR = 12.0, 6.0, 5.0
SMALL_SAMPLE = 5
#: Logistic of the shape classifier: bias, slope divergence, spike, seasonality, evergreen, long trend; and its cut-offs.
FAD = (-1.0, 1.8, 0.8, 0.5, -1.6, -1.2)
EVERGREEN_RATIO, FAD_PROBABILITY, FLAT_DIVERGENCE = 0.35, 0.6, 0.5
#: Revenue model rev1.
REVENUE = {"version": "rev1", "scale": 30.0, "tam_sigma": 0.9, "ctr": (2.0, 38.0), "cvr": (2.0, 28.0), "price_sigma": 0.3, "draws": 4000}
ALPHA = 0.3
KEEP_SHARE, KEEP_LEAST, MAX_AGE_DAYS = 0.05, 10, 90
CHUNK_SIZE, SHOWN_CHARS = 100, 500

#: Sources whose rows are no texts and give no product names.
EXCLUDED_SOURCES = ("wiki_pageviews",)
#: Parts of messages of errors that may pass by themselves.
TRANSIENT_MARKERS = ("429", "500", "502", "503", "504", "timeout", "timed out", "overloaded", "unavailable", "rate limit")
