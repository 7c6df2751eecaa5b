"""Reading level of running prose: a linear pairwise ranker, calibrated into levels by isotonic regression."""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What stands around running prose in markdown, in the order in which it is taken out.
_AROUND = (
    (r"(?s)\A\s*---[ \t]*\n.*?\n---[ \t]*(?:\n|\z)", ""),  # front matter
    (r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\z)", "\n\n"),  # fenced code
    (r"(?s)<!--.*?-->", "\n"),
    (r"(?m)^[ \t]{0,3}#{1,6}(?:[ \t].*)?$", "\n"),  # headings
    (r"(?m)^[^\n]+\n(?:={3,}|-{3,})[ \t]*$", "\n"),
    (r"(?m)^(?: {4}|\t).*$", "\n"),  # indented code
    (r"(?m)^[ \t]*\|.*$", "\n"),  # tables
    (r"(?m)^[ \t]*(?:[-*+•]|\d{1,3}[.)])[ \t].*$", "\n"),  # lists
    (r"(?m)^[ \t]*\[[^\]\n]+\]:.*$", "\n"),
    (r"!?\[[^\]\n]*\]\([^)\n]*\)", " "),  # links
    (r"<?https?://\S+", " "),
    (r"</?[A-Za-z][^<>\n]{0,60}>", " "),
    (r"(?m)^[ \t]*>+[ \t]?", ""),
    (r"[`*_~]+", ""),
)

_SUBORDINATE = r"(?i)\b(?:because|although|though|unless|whereas|while|whenever|since|provided|given|notwithstanding|insofar|inasmuch|whether|which|whose|whom|that|thereby|thus|consequently)\b"


def prose(text: str | Column) -> Column:
    """Sentences in paragraphs, without front matter, headings, code, tables, lists, links and other markup."""
    out = F.regexp_replace(F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"\r\n?", "\n"), "^\ufeff", "")
    for pattern, by in _AROUND:
        out = F.regexp_replace(out, pattern, by)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def features(text: Column) -> dict[str, Column]:
    """Counts of a text of running prose; the shares of ``SHARES`` follow from them."""
    return {
        "n_words": F.regexp_count(text, F.lit(r"\p{L}[\p{L}\p{M}'’]*")),
        "n_letters": F.regexp_count(text, F.lit(r"\p{L}")),
        "n_sentences": F.greatest(F.regexp_count(text, F.lit(r"[.!?…]+(?=\s|$)")), F.lit(1)),
        "n_syllables": F.regexp_count(text, F.lit(r"(?i)[aeiouyà-öø-ü]+")),
        "n_long": F.regexp_count(text, F.lit(r"\p{L}{7,}")),
        "n_longer": F.regexp_count(text, F.lit(r"\p{L}{10,}")),
        "n_longest": F.regexp_count(text, F.lit(r"\p{L}{13,}")),
        "n_commas": F.regexp_count(text, F.lit(r"[,;:]")),
        "n_clauses": F.regexp_count(text, F.lit(_SUBORDINATE)),
    }


# Syntax: length and joints of sentences. Vocabulary: length and make of words.
SHARES = {
    "sentence_length": lambda c: F.log(c["n_words"] / c["n_sentences"]),
    "commas": lambda c: c["n_commas"] / c["n_sentences"],
    "clauses": lambda c: c["n_clauses"] / c["n_sentences"],
    "word_length": lambda c: c["n_letters"] / c["n_words"],
    "syllables": lambda c: c["n_syllables"] / c["n_words"],
    "long": lambda c: c["n_long"] / c["n_words"],
    "longer": lambda c: c["n_longer"] / c["n_words"],
    "longest": lambda c: c["n_longest"] / c["n_words"],
}


def profile(df: DataFrame, text_col: str, keep: list[str], min_words: int) -> DataFrame:
    """``keep``, ``n_words`` and the shares of every text with at least ``min_words`` words of prose."""
    # explode() keeps the optimizer from writing the whole chain of replacements into each of the counts.
    counted = df.select(*keep, F.explode(F.array(prose(F.col(text_col).cast("string")))).alias("_prose")).where("_prose <> ''")
    counted = counted.select(*keep, F.explode(F.array(F.struct(*[c.alias(n) for n, c in features(F.col("_prose")).items()]))).alias("_c"))
    counted = counted.select(*keep, *[F.col(f"_c.{n}").alias(f"_{n}") for n in features(F.lit(""))]).where(F.col("_n_words") >= max(1, min_words))
    at = {n: F.col(f"_{n}") for n in features(F.lit(""))}
    return counted.select(*keep, F.col("_n_words").alias("n_words"), *[f(at).alias(n) for n, f in SHARES.items()])


@dataclass(frozen=True)
class Ranker:
    weights: dict[str, float]
    scores: list[float]
    levels: list[float]

    def score(self) -> Column:
        return sum((F.col(n) * w for n, w in self.weights.items()), F.lit(0.0))

    def level(self) -> Column:
        """The calibrated level, linear between the points of the isotonic fit and rounded."""
        at, out = self.score(), F.lit(self.levels[0])
        for (a, la), (b, lb) in zip(zip(self.scores, self.levels), zip(self.scores[1:], self.levels[1:])):
            out = F.when(at >= b, lb).when(at > a, la + (lb - la) * (at - a) / (b - a)).otherwise(out) if b > a else F.when(at >= b, lb).otherwise(out)
        return F.floor(out + 0.5).cast("int")


def isotonic(scores: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares fit of levels that never fall with the score (pool adjacent violators): two points per pool."""
    order = np.argsort(scores, kind="stable")
    pools: list[list[float]] = []  # sum, count, first score, last score
    for s, y in zip(scores[order], levels[order]):
        pools.append([float(y), 1, float(s), float(s)])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            y2, n2, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + y2, pools[-1][1] + n2, pools[-1][2], last]
    return np.array([x for p in pools for x in (p[2], p[3])]), np.array([p[0] / p[1] for p in pools for _ in (0, 1)])


def fit(samples: DataFrame, text_col: str, grade_col: str, max_samples: int = 5000, rounds: int = 300, decay: float = 1e-3) -> Ranker:
    """A linear ranker from all pairs of samples of different grade (logistic loss), and its isotonic calibration.

    At most ``max_samples`` samples are used, those that come first by a hash of their text; ties in the hash are equal
    texts. Samples without prose or grade are left out; at least two grades must remain.
    """
    graded = samples.where(F.col(grade_col).isNotNull()).select(F.col(grade_col).cast("double").alias("grade"), F.col(text_col).alias("text"))
    rows = profile(graded.orderBy(F.xxhash64("text"), "text", "grade").limit(max_samples), "text", ["grade"], 1).collect()
    names = list(SHARES)
    x, y = np.array([[r[n] for n in names] for r in rows], float).reshape(len(rows), len(names)), np.array([r["grade"] for r in rows], float)
    if len(set(y)) < 2:
        raise ValueError("samples of at least two grades are needed")
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    spread = np.where(x.std(0) > 0, x.std(0), 1)
    z = (x - x.mean(0)) / spread
    pairs = sum(float((y[:, None] > y[None, at : at + 256]).sum()) for at in range(0, len(y), 256))
    w = np.zeros(len(names))
    for _ in range(rounds):
        s = z @ w
        # The gradient over pairs (i above j) needs no list of differences: each sample counts by its pairs' residues.
        # They are taken in blocks, so memory grows with the samples alone.
        pull = np.zeros(len(y))
        for at in range(0, len(y), 256):
            part = slice(at, at + 256)
            residue = (y[:, None] > y[None, part]) / (1 + np.exp(np.clip(s[:, None] - s[None, part], -30, 30)))
            pull += residue.sum(1)
            pull[part] -= residue.sum(0)
        gradient = z.T @ pull / pairs - decay * w
        w += 2.0 * gradient
    weights = w / spread
    scores, levels = isotonic(x @ weights, y)
    return Ranker(dict(zip(names, map(float, weights))), [float(s) for s in scores], [float(v) for v in levels])


def reading_levels(docs: DataFrame, id_col: str, text_col: str, ranker: Ranker, min_words: int = 80) -> DataFrame:
    """``id_col, n_words, score, grade`` of every text with at least ``min_words`` words of running prose.

    Null, empty and shorter texts have no row; repeated rows come out as often as they stand there; other columns are
    ignored. One pass of built-in expressions, without shuffle.
    """
    rows = profile(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text", ["_id"], min_words)
    return rows.select(F.col("_id").alias(id_col), "n_words", ranker.score().alias("score"), ranker.level().alias("grade"))
