"""Word lists, scores, patterns and defaults that decide results.

Everything here is data, not logic.  Every function that uses one of these
takes it as a parameter with the value below as its default.
"""

# ---------------------------------------------------------------------------
# Material scores.  Order matters, the first contained key wins.
MATERIAL_SCORES = (
    ("tencel", 9.0),
    ("lyocell", 9.0),
    ("linen", 8.5),
    ("hemp", 9.0),
    ("organic cotton", 8.5),
    ("recycled cotton", 8.0),
    ("recycled polyester", 7.5),
    ("merino wool", 8.0),
    ("wool", 7.5),
    ("cotton", 6.0),
    ("viscose", 5.0),
    ("rayon", 5.0),
    ("polyester", 3.0),
    ("virgin polyester", 2.0),
    ("acrylic", 2.5),
    ("nylon", 3.5),
    ("spandex", 3.0),
    ("elastane", 3.0),
)
UNKNOWN_MATERIAL_SCORE = 5.0

# Names a material collapses to, tried in this order, and the synonym.
MATERIAL_BASES = ("organic cotton", "cotton", "virgin polyester", "recycled polyester")
MATERIAL_SYNONYM = ("elastane", "spandex")

# How one part of a composition text is read.
COMPOSITION_SEPARATORS = r"[,/;+]"
PERCENT_MATERIAL = r"(?U)([0-9]{1,3})\s*%\s*([a-z\s]+)"
NOT_MATERIAL = r"(?U)[^a-z\s]"

# Price patterns.
FIRST_NUMBER = r"(\d+\.?\d*)"
NOT_PRICE = r"[^0-9\.]"

# Marketing claim keywords, matched as substrings.
CLAIM_KEYWORDS = (
    "eco", "eco-friendly", "conscious", "sustainable", "responsible",
    "recycled", "organic", "green", "earth", "low-impact",
)
LOW_QUALITY_LIMIT = 4.0

# Durability phrases, matched as substrings, each once per text.
DURABLE_PHRASES = (
    "durable", "long lasting", "long-lasting", "well made", "well-made", "held up",
    "high quality", "sturdy", "robust", "lasted", "lasts",
)
FRAGILE_PHRASES = (
    "fell apart", "tore", "ripped", "cheaply made", "wore out", "wore-out",
    "broke", "hole", "pilled", "shrunk", "threads came loose",
)

# Brands (lower case) and their categories.
FAST_FASHION_BRANDS = ("shein", "zara", "h&m", "hm", "h & m")
SUSTAINABLE_BRANDS = ("patagonia", "everlane", "reformation")
CATEGORIES = ("fast_fashion", "sustainable")

# Marker in a file name -> brand.  The order is ours: longest first.
FILE_BRANDS = (
    ("reformation", "reformation"),
    ("patagonia", "patagonia"),
    ("everlane", "everlane"),
    ("shein", "shein"),
    ("zara", "zara"),
    ("h&m", "h&m"),
    ("hm", "h&m"),
)

# Column synonyms for the normalized product, first present wins.
PRODUCT_SYNONYMS = {
    "brand": ("brand", "Brand", "seller", "store"),
    "title": ("title", "Title", "name", "Name", "product_name"),
    "description": ("description", "Description", "details", "Details", "product_description"),
    "materials": ("materials", "Materials", "material", "Material", "composition", "Composition"),
    "review_text": ("review_text", "reviews", "Review", "Comments", "comment", "Comment"),
    "product_id": ("id", "ID", "sku", "product_id"),
    "price": ("price", "Price", "product_price", "sale_price"),
}

# Column synonyms of the two generic cleaners.
H_AND_M_SYNONYMS = {
    "url": ("url", "product_url"),
    "name": ("name", "product_name"),
    "sku": ("sku", "product_id"),
    "price": ("price", "Price"),
    "materials": ("description", "product_description"),
}
PATAGONIA_SYNONYMS = {
    "url": ("url", "URL"),
    "name": ("name", "Name"),
    "sku": (),
    "price": ("price", "Price"),
    "materials": ("description", "Description"),
}

# Texts a CSV reader of the analysis takes for a missing value.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Forum text cleaning, patterns replaced by one blank, in this order.
FORUM_NOISE = (
    r"\[[^\]]+\]\([^\)]+\)",   # [text](url)
    r"https?://\S+|www\.\S+",
    r"/u/\S+|u/\S+|@\S+",
    r"<[^>]+>",
    r"[^a-z0-9]+",             # punctuation and runs of white space in one pass
)
MIN_TOKENS = 5

# Defaults of the forum extract.
FORUM_SUBREDDITS = ("mensfashion", "malefashionadvice", "womensfashion", "femalefashionadvice")
FORUM_YEARS = (2023, 2024)
FORUM_MONTHS = (1, 2, 3)

# Text columns the batch sentiment looks for.
TEXT_COLUMNS = ("body", "title", "selftext")

# Tercile probabilities and k-means defaults.
TERCILES = (0.33, 0.66)
QUARTILES = (0.25, 0.5, 0.75)
CLUSTER_FEATURES = ("price", "sentiment_score", "durability_score", "objective_quality_score")
CLUSTERS = 4
CLUSTER_SEED = 42
CLUSTER_ITERATIONS = 300
CLUSTER_TOLERANCE = 1e-4
