"""Rule-based classification, sentiment, keywords and summaries.

The dictionaries are literals, so scoring is a sum of `contains` expressions in
generated code without any shuffle; only keyword frequencies are counted in
Arrow batches, in time linear to the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WORD, most_frequent

# --- fixed values: categories with their keywords, sentiment words, stop words
CATEGORY_KEYWORDS = {
    "Technology": ["software", "hardware", "programming", "code", "developer", "api", "cloud", "data", "ai", "machine learning", "app", "tech", "computer", "digital", "algorithm", "startup", "silicon valley", "innovation"],
    "Business": ["company", "market", "revenue", "profit", "ceo", "startup", "investment", "stock", "enterprise", "corporate", "management", "strategy", "growth"],
    "News": ["breaking", "latest", "update", "report", "announced", "today", "yesterday", "official", "statement", "press", "media"],
    "Blog": ["personal", "opinion", "thoughts", "my experience", "i think", "review", "journey", "story", "lessons learned"],
    "E-commerce": ["buy", "shop", "cart", "price", "discount", "sale", "order", "shipping", "product", "store", "checkout", "add to cart"],
    "Entertainment": ["movie", "music", "game", "celebrity", "streaming", "show", "series", "album", "concert", "entertainment", "fun"],
    "Education": ["learn", "course", "tutorial", "study", "university", "school", "student", "teacher", "education", "training", "lesson", "class"],
    "Health": ["health", "medical", "doctor", "hospital", "treatment", "symptom", "disease", "wellness", "fitness", "diet", "nutrition", "exercise"],
    "Sports": ["game", "team", "player", "score", "championship", "league", "football", "basketball", "soccer", "match", "tournament"],
    "Travel": ["travel", "vacation", "hotel", "flight", "destination", "trip", "tourism", "adventure", "explore", "booking", "resort"],
    "Food": ["recipe", "restaurant", "cooking", "food", "meal", "ingredient", "chef", "cuisine", "dining", "taste", "delicious"],
    "Finance": ["money", "bank", "loan", "credit", "investment", "financial", "budget", "savings", "insurance", "mortgage", "crypto", "bitcoin"],
    "Science": ["research", "study", "scientist", "experiment", "discovery", "physics", "chemistry", "biology", "space", "nature"],
}
DEFAULT_CATEGORIES = ["Technology", "Business", "News", "Blog", "E-commerce", "Entertainment", "Education", "Health", "Sports", "Travel", "Food", "Finance", "Government", "Science", "Art & Design"]
POSITIVE = ["good", "great", "excellent", "amazing", "wonderful", "best", "love", "awesome", "fantastic", "perfect", "happy", "success", "beautiful", "brilliant", "outstanding", "incredible"]
NEGATIVE = ["bad", "terrible", "awful", "worst", "hate", "poor", "fail", "wrong", "horrible", "disappointing", "ugly", "broken", "sad", "angry", "frustrated", "problem", "issue", "error"]
STOPWORDS = """
the a an is are was were be been being have has had do does did will would could should may might can this that these those i you he she it we they
what which who when where why how all each every both few more most other some such no not only same so than too very just but and or if because as
until while of at by for with about against between into through during before after above below to from up down in out on off over under
""".split()
WORDS_PER_MINUTE, MOST_KEYWORDS, SUMMARY_PIECES, SUMMARY_LEAST, SUMMARY_CHARS = 200, 10, 3, 20, 300
# --- end of fixed values


def lowered(title: Column, text: Column) -> Column:
    """Title and text in one, lower case; nulls count as empty."""
    return F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))))


def _occurring(text: Column, words: list[str]) -> Column:
    return sum((text.contains(w).cast("int") for w in words), F.lit(0))


def category_scores(text: Column) -> Column:
    """Categories with a score, best first; the score is the number of the
    category's keywords that occur anywhere in the lower-case text, ties keep
    the order of the dictionary."""
    scored = F.array(*[F.struct(_occurring(text, words).alias("score"), F.lit(-i).alias("ord"), F.lit(name).alias("category")) for i, (name, words) in enumerate(CATEGORY_KEYWORDS.items())])
    return F.sort_array(F.filter(scored, lambda s: s["score"] > 0), asc=False)


def sentiment(text: Column) -> tuple[Column, Column]:
    """Label and score from the numbers of different positive and negative words:
    one side needs more than one and a half times the other."""
    pos, neg = _occurring(text, POSITIVE), _occurring(text, NEGATIVE)
    share = lambda n: F.least(F.lit(1.0), n / (pos + neg + 1))
    label = F.when(pos > neg * 1.5, "positive").when(neg > pos * 1.5, "negative").otherwise("neutral")
    score = F.when(label == "positive", share(pos)).when(label == "negative", -share(neg)).otherwise(0.0)
    return label, F.round(score, 2)


def words(text: Column) -> Column:
    """Words of a lower-case text, underscores included."""
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def keywords(found: Column, most: int = MOST_KEYWORDS) -> Column:
    """The most frequent words over three letters that are no stop words; ties by
    first occurrence."""
    kept = F.filter(found, lambda w: (F.length(w) > 3) & ~w.isin(STOPWORDS))
    return most_frequent(kept, F.lit(most))


def summary(text: Column) -> Column:
    """First pieces between sentence ends that are longer than twenty
    characters, joined and cut."""
    pieces = F.slice(F.split(F.coalesce(text, F.lit("")), "[.!?]+", -1), 1, SUMMARY_PIECES)
    trimmed = F.transform(pieces, lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.substring(F.array_join(F.filter(trimmed, lambda s: F.length(s) > SUMMARY_LEAST), ". "), 1, SUMMARY_CHARS)


def classify(pages: DataFrame, title: str = "title", text: str = "text") -> DataFrame:
    """`pages` with category, category_confidence, secondary_categories, keywords,
    sentiment, sentiment_score, entities (none), summary, word_count and
    reading_time_minutes; existing columns of these names are replaced.  A text
    without any keyword is `Unknown` with confidence 0."""
    scores, low, found = F.col("_scores"), F.col("_low"), F.col("_words")
    total = F.aggregate(scores, F.lit(0), lambda acc, s: acc + s["score"])
    label, score = sentiment(low)
    out = pages.withColumn("_low", lowered(F.col(title), F.col(text))).withColumns({"_scores": category_scores(low), "_words": words(low)})
    found_any = F.size(scores) > 0
    return out.withColumns({
        "category": F.when(found_any, F.try_element_at(scores, F.lit(1))["category"]).otherwise("Unknown"),
        "category_confidence": F.when(found_any, F.round(F.try_element_at(scores, F.lit(1))["score"] / total, 2)).otherwise(0.0),
        "secondary_categories": F.transform(F.slice(scores, 2, 2), lambda s: s["category"]),
        "keywords": keywords(found), "sentiment": label, "sentiment_score": score, "entities": F.array().cast("array<string>"), "summary": summary(F.col(text)),
        "word_count": F.size(found).cast("long"), "reading_time_minutes": F.round(F.size(found) / WORDS_PER_MINUTE, 1),
    }).drop("_low", "_scores", "_words")


SESSION_CHARS, SESSION_KEYWORDS = 3_000, 5  # fixed values: what a session's report reads and shows of a page


def classify_session(content: DataFrame, limit: int = 20) -> DataFrame:
    """Classes of a session's first records, by the beginning of their texts, with
    a few keywords each."""
    chosen = content.select("url", "title", F.substring(F.coalesce("text", F.lit("")), 1, SESSION_CHARS).alias("text")).limit(limit)
    return classify(chosen).withColumn("keywords", F.slice("keywords", 1, SESSION_KEYWORDS))


def distribution(classified: DataFrame) -> DataFrame:
    """Pages and share of each category."""
    counts = classified.groupBy("category").agg(F.count("*").alias("pages"))
    return counts.withColumn("share", F.col("pages") / counts.agg(F.sum("pages")).scalar())
