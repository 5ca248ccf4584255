"""Fixed values of the published rule-based sentiment method (Hutto & Gilbert, ICWSM 2014).

``DEFAULT_LEXICON`` is a short list of common words with their published
valences.  A full lexicon is a parameter: see ``sources.readers.read_lexicon``.
"""

# Weights of the method.
BOOST = 0.293
CAPITALS_BOOST = 0.733
NEGATION_FACTOR = -0.74
DISTANCE_WEIGHTS = (1.0, 0.95, 0.9)
NEVER_FACTORS = (None, 1.5, 1.25)
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
EXCLAMATION_WEIGHT, EXCLAMATION_LIMIT = 0.292, 4
QUESTION_WEIGHT, QUESTION_LIMIT, QUESTION_MAXIMUM = 0.18, 3, 0.96
NORMALIZATION = 15.0

# Punctuation, and the marks that are taken off one end of a word.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WORD_EDGES = (
    ".", "!", "?", ",", ";", ":", "-", "'", '"', "!!", "!!!", "??", "???", "?!?", "!?!", "?!?!", "!?!?",
)

# Words that strengthen or weaken what follows.
INTENSIFIERS = (
    "absolutely", "amazingly", "awfully", "completely", "considerably", "decidedly", "deeply",
    "effing", "enormously", "entirely", "especially", "exceptionally", "extremely", "fabulously",
    "flipping", "flippin", "fricking", "frickin", "frigging", "friggin", "fully", "fucking",
    "greatly", "hella", "highly", "hugely", "incredibly", "intensely", "majorly", "more", "most",
    "particularly", "purely", "quite", "really", "remarkably", "so", "substantially",
    "thoroughly", "totally", "tremendously", "uber", "unbelievably", "unusually", "utterly", "very",
)
DAMPENERS = (
    "almost", "barely", "hardly", "kinda", "kindof", "kind-of", "less", "little", "marginally",
    "occasionally", "partly", "scarcely", "slightly", "somewhat", "sorta", "sortof", "sort-of",
)
DAMPENER_PAIRS = ("just enough", "kind of", "sort of")

# Negations.
NEGATIONS = (
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt", "ain't", "aren't",
    "can't", "couldn't", "daren't", "didn't", "doesn't", "dont", "hadnt", "hasnt", "havent",
    "isnt", "mightnt", "mustnt", "neither", "don't", "hadn't", "hasn't", "haven't", "isn't",
    "mightn't", "mustn't", "neednt", "needn't", "never", "none", "nope", "nor", "not", "nothing",
    "nowhere", "oughtnt", "shant", "shouldnt", "uhuh", "wasnt", "werent", "oughtn't", "shan't",
    "shouldn't", "uh-uh", "wasn't", "weren't", "without", "wont", "wouldnt", "won't", "wouldn't",
    "rarely", "seldom", "despite",
)

# Idioms with a valence of their own.
IDIOMS = (
    ("the shit", 3.0), ("the bomb", 3.0), ("bad ass", 1.5), ("yeah right", -2.0),
    ("cut the mustard", 2.0), ("kiss of death", -1.5), ("hand to mouth", -2.0),
)

# Word valences between -4 and 4.
DEFAULT_LEXICON = {
    "admire": 2.1, "adorable": 2.2, "amazing": 2.8, "angry": -2.3, "annoying": -1.7,
    "appreciate": 1.7, "attractive": 1.9, "awesome": 3.1, "awful": -2.0, "bad": -2.5,
    "beautiful": 2.9, "best": 3.2, "better": 1.9, "boring": -1.3, "broken": -2.1,
    "charming": 2.8, "cheer": 2.3, "comfort": 1.5, "comfortable": 2.3, "complain": -1.5,
    "complaint": -1.2, "confident": 2.2, "cool": 1.3, "cute": 2.0, "damage": -2.2,
    "damaged": -1.9, "defect": -1.4, "delight": 2.9, "delighted": 2.3, "dirty": -1.9,
    "disappointed": -2.1, "disappointing": -2.2, "disappointment": -2.3, "disgusting": -2.4,
    "dislike": -1.6, "easy": 1.9, "elegant": 2.1, "enjoy": 2.2, "excellent": 2.7,
    "excited": 1.4, "fail": -2.5, "failed": -2.3, "fake": -2.1, "fantastic": 2.6,
    "favorite": 2.0, "fine": 0.8, "fit": 1.5, "flawless": 2.3, "free": 2.3, "fresh": 1.3,
    "friendly": 2.2, "fun": 2.3, "funny": 1.9, "generous": 2.3, "glad": 2.0, "good": 1.9,
    "gorgeous": 3.0, "great": 3.1, "happy": 2.7, "hate": -2.7, "hated": -3.2, "helpful": 1.8,
    "hope": 1.9, "horrible": -2.5, "hurt": -2.4, "impressed": 2.1, "impressive": 2.3,
    "improve": 1.9, "joy": 2.8, "kind": 2.4, "lame": -1.8, "like": 1.5, "liked": 1.8,
    "lousy": -2.5, "love": 3.2, "loved": 2.9, "lovely": 2.8, "mad": -2.2, "mistake": -1.4,
    "nice": 1.8, "no": -1.2, "outstanding": 3.0, "pain": -2.3, "perfect": 2.7,
    "perfectly": 3.2, "pleasant": 2.3, "pleased": 1.9, "poor": -2.1, "pretty": 2.2,
    "problem": -1.7, "problems": -1.7, "proud": 2.1, "recommend": 1.5, "regret": -1.8,
    "relaxed": 2.2, "ridiculous": -1.5, "ruin": -2.8, "ruined": -2.1, "sad": -2.1,
    "satisfied": 1.8, "scam": -2.7, "scary": -2.2, "smart": 1.7, "sorry": -0.3,
    "straight": 0.9, "strong": 2.3, "stunning": 1.6, "stupid": -2.4, "success": 2.7,
    "sucks": -1.5, "super": 2.9, "terrible": -2.1, "terrific": 2.1, "thank": 1.5,
    "thanks": 1.9, "ugly": -2.3, "unhappy": -1.8, "upset": -1.6, "useful": 1.9,
    "useless": -1.8, "warm": 0.9, "waste": -1.8, "weak": -1.9, "welcome": 2.0, "well": 1.1,
    "win": 2.8, "wonderful": 2.7, "worried": -1.2, "worse": -2.1, "worst": -3.1,
    "worthless": -1.9, "wrong": -2.1, ":)": 2.0, ":(": -1.9, "<3": 1.9,
}
