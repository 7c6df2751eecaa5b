"""One form for text that looks the same: compatibility normalization, ignorable characters, look-alike lattices."""

import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters and marks that look alike, the preferred one first.
LOOK_ALIKE = (
    "aаɑα cсϲ dԁ eеҽ gɡց hһհ iіιıɩ jјϳ kкκ lӏ nո oоοօ pрρ qԛգ rг sѕ uսυ vνѵ wԝաѡ xх yуүγ zᴢ "
    "AАΑ BВΒ CСϹ EЕΕ FϜ GԌ HНΗ IІΙӀ JЈ KКΚ MМΜ NΝ OОΟՕ PРΡ SЅՏ TТΤ UՍ VѴ WԜ XХΧ YҮΥ ZΖ "
    "-‐‑ /⁄∕ :꞉"
).split()
#: Characters without any look of their own (Unicode's default ignorables and format characters beside those of category Cf).
IGNORABLE = re.compile("[\u034f\u115f\u1160\u17b4\u17b5\u180b-\u180f\u3164\uffa0\ufe00-\ufe0f\U000e0000-\U000e0fff]")
BLANK = re.compile(r"[\s\u2800]+")

CLASS = {c: k for k, cs in enumerate(LOOK_ALIKE) for c in cs}
# What looks much alike in many fonts, though not the same; there the context decides.
NEARLY = {"l": "I1", "I": "l1", "1": "lI", "0": "O", "O": "0"}
MERGED = {"rn": "m", "vv": "w", "cl": "d"}
OPEN = "^"


@lru_cache(4096)
def script(char: str) -> str:
    """LATIN, GREEK, CYRILLIC, ...: the first word of a letter's name; empty for what is no letter."""
    return unicodedata.name(char, "").split(" ")[0] if char.isalpha() else ""


def plain(text: str) -> str:
    """Compatibility decomposition without ignorable characters and with single blanks, none at the ends."""
    text = unicodedata.normalize("NFKD", IGNORABLE.sub("", text))
    kept = "".join(c for c in text if c.isspace() or unicodedata.category(c) not in ("Cf", "Cc"))
    # What was hidden between a letter and its marks is gone, so the marks' order is settled again.
    return BLANK.sub(" ", unicodedata.normalize("NFKD", kept)).strip()


def _symbol(char: str) -> str:
    """A character of the tables or of ASCII stands for itself, any other letter for its script: so there is a fixed number of symbols."""
    return char if char in CLASS or (char.isascii() and char.isalnum()) else script(char) or "."


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", re.sub(r"[\u0300-\u036f]", "", text))


def count_runs(texts) -> Counter:
    """Runs of three symbols in words whose letters are of one script."""
    found: Counter = Counter()
    for text in texts:
        for word in words(plain(text)):
            if len({script(c) for c in word} - {""}) == 1:
                marks = [OPEN, OPEN, *map(_symbol, word), OPEN]
                found.update(zip(marks, marks[1:], marks[2:]))
    return found


class Model:
    """Log-probabilities of the next symbol after two others; moving between scripts, and reading a character as one that only nearly looks like it, costs extra."""

    def __init__(self, runs: dict[tuple[str, str, str], int], penalty: float = 12.0, nearly: float = 6.0, beam: int = 8):
        self.three, self.two, self.one, total = dict(runs), Counter(), Counter(), 0
        self.after_two, self.after_one = Counter(), Counter()
        for (a, b, c), n in runs.items():
            self.two[b, c] += n
            self.one[c] += n
            self.after_two[a, b] += n
            self.after_one[b] += n
            total += n
        self.total, self.penalty, self.nearly, self.beam = total, penalty, nearly, beam
        self._scores: dict[tuple[str, str, str], float] = {}
        self._known: dict[str, str] = {}

    def score(self, a: str, b: str, c: str) -> float:
        if (a, b, c) not in self._scores:
            x, y, z = (s if s == OPEN else _symbol(s) for s in (a, b, c))
            three = self.three.get((x, y, z), 0) / max(1, self.after_two[x, y])
            two, one = self.two[y, z] / max(1, self.after_one[y]), self.one[z] / max(1, self.total)
            change = OPEN not in (b, c) and script(b) != script(c) and "" not in (script(b), script(c))
            self._scores[a, b, c] = math.log(0.7 * three + 0.25 * two + 0.049 * one + 1e-6) - self.penalty * change
        return self._scores[a, b, c]

    def _options(self, look: str, at: int):
        """(what stands there, characters that it takes, cost) for each reading of the place."""
        c = look[at]
        yield from ((o, 1, 0.0) for o in (LOOK_ALIKE[CLASS[c]] if c in CLASS else c))
        yield from ((o, 1, self.nearly) for o in NEARLY.get(c, ""))
        if look[at : at + 2] in MERGED:
            yield MERGED[look[at : at + 2]], 2, self.nearly

    def word(self, word: str) -> list[tuple[str, int]]:
        """The best path (Viterbi) through the readings of a word: characters, and how many of the word each stands for.

        Of characters that look the same, the spelling does not matter itself: their readings are the same.
        """
        look = "".join(LOOK_ALIKE[CLASS[c]][0] if c in CLASS else c for c in word)
        if look not in self._known:
            if len(self._known) > 200_000:
                self._known.clear()
            ends: list[dict] = [{} for _ in range(len(look) + 1)]
            ends[0][OPEN, OPEN] = (0.0, ())
            for at in range(len(look)):
                for (a, b), (score, path) in sorted(ends[at].items(), key=lambda x: (-x[1][0], x[0]))[: self.beam]:
                    for o, n, cost in self._options(look, at):
                        reached = score + self.score(a, b, o) - cost
                        held = ends[at + n].get((b, o))
                        if held is None or reached > held[0]:
                            ends[at + n][b, o] = (reached, (*path, (o, n)))
            self._known[look] = list(max(((s + self.score(a, b, OPEN), path) for (a, b), (s, path) in sorted(ends[-1].items())), key=lambda x: x[0])[1])
        return self._known[look]

    def form(self, text: str) -> str:
        out, marks = [], []

        def close():
            letters = "".join(c for c, _ in marks)
            if not any(map(str.isalpha, letters)):
                out.extend(c + m for c, m in marks)
            else:
                at = 0
                for c, n in self.word(letters):
                    out.append(c + "".join(m for _, m in marks[at : at + n]))
                    at += n
            marks.clear()

        for c in plain(text):
            if unicodedata.combining(c) and marks:
                marks[-1] = (marks[-1][0], marks[-1][1] + c)
            elif c.isalnum():
                marks.append((c, ""))
            else:
                close()
                out.append(LOOK_ALIKE[CLASS[c]][0] if c in CLASS else c)
        close()
        return unicodedata.normalize("NFC", "".join(out))


def learn(texts: DataFrame) -> Model:
    """The model of a table's first column, over all its distinct texts.

    Only counts of runs of three fixed symbols reach the driver: at most (symbols of the tables + scripts)³ of them, and
    no more than stand in words.
    Null and empty texts count for nothing; an empty table gives a model that only keeps words to one script.
    """
    column = texts.columns[0]

    def runs(batches):
        found: Counter = Counter()
        for pdf in batches:
            found.update(count_runs(pdf[column].dropna()))
        yield pd.DataFrame([(a, b, c, n) for (a, b, c), n in found.items()], columns=["a", "b", "c", "n"])

    rows = texts.select(column).distinct().mapInPandas(runs, "a string, b string, c string, n bigint").groupBy("a", "b", "c").agg(F.sum("n").alias("n")).collect()
    return Model({(r.a, r.b, r.c): r.n for r in sorted(rows)})


def visual_form(column: str | Column, model: Model) -> Column:
    """The one form of all texts that look like the given one; null stays null, and an empty or invisible text is empty.

    Forms made with one model compare with each other. Letter case, accents, words and order stay.
    """

    @F.pandas_udf("string")
    def form(values: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        return values.map(lambda x: None if x is None else known.setdefault(x, model.form(x)) if x not in known else known[x])

    return form(column)


def lookalike_rows(rows: DataFrame, id_col: str, sources: DataFrame, titles: DataFrame, salts: int = 16) -> DataFrame:
    """Rows whose ``source_file`` or ``title`` is written otherwise than in the collection but looks the same.

    ``rows`` has ``id_col, source_file, title``; ``sources`` has ``source_file``; ``titles`` has ``source_file, title``.
    Returns ``id_col`` and ``source_file`` as written in ``sources``, each pair once. A null or unknown source gives no
    row, a null title never counts as a look-alike. Other columns of the three tables are ignored.

    Forms are made of distinct values only; of a hot source or title one copy moves. The result goes back to the rows
    over a salted key, since one pair may stand in a third of them.
    """
    given = rows.select(F.col(id_col).alias("_id"), F.col("source_file").alias("_s"), F.col("title").alias("_t"))
    homes = sources.select(F.col("source_file").alias("home")).where("home IS NOT NULL").distinct()
    heads = titles.select(F.col("source_file").alias("home"), F.col("title").alias("head")).dropna().distinct()
    pairs = given.where("_s IS NOT NULL").select("_s", "_t").distinct()
    model = learn(homes.select(F.col("home").alias("x")).unionByName(heads.select(F.col("head").alias("x"))).unionByName(pairs.select(F.explode(F.array("_s", "_t")).alias("x"))))

    placed = pairs.withColumn("_f", visual_form("_s", model)).join(homes.withColumn("_f", visual_form("home", model)), "_f").drop("_f")
    exact = heads.select("home", F.col("head").alias("_t"), F.lit(True).alias("_same"))
    alike = heads.select("home", visual_form("head", model).alias("_tf")).distinct().withColumn("_like", F.lit(True))
    judged = placed.join(exact, ["home", "_t"], "left").withColumn("_tf", visual_form("_t", model)).join(alike, ["home", "_tf"], "left")
    judged = judged.where((F.col("_s") != F.col("home")) | (F.col("_same").isNull() & F.col("_like").isNotNull()))
    judged = judged.select("_s", "_t", "home", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    salted = given.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int"))
    back = salted.alias("g").join(judged.alias("j"), (F.col("g._s") == F.col("j._s")) & F.col("g._t").eqNullSafe(F.col("j._t")) & (F.col("g._salt") == F.col("j._salt")))
    return back.select(F.col("g._id").alias(id_col), F.col("j.home").alias("source_file")).distinct()
