"""Personal data in free text: labelers vote on spans, expectation-maximisation weighs them, a span classifier decides."""

import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "phone", "id_number", "address", "name")
BUCKETS = 1 << 16  # of the hashed word statistics and of the classifier's hashed features

# Common given names of several languages, for the gazetteer where no other list is passed.
GIVEN_NAMES = (
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Christopher Lisa Daniel Nancy "
    "Matthew Betty Anthony Sandra Andrew Emily Joshua Michelle Kevin Laura Brian Rebecca Edward Deborah Jason Stephanie Peter Hannah Paul Olivia Emma Sophie Alice Oliver Harry "
    "Hans Klaus Jürgen Wolfgang Stefan Andreas Monika Ursula Sabine Petra Anna Julia Lukas Felix Pierre Jean Marie Camille Luc Antoine Isabelle Claire José Juan Carlos Luis María Carmen "
    "Ana Javier Pablo Lucía Marco Giulia Francesco Paolo Ivan Dmitri Sergei Olga Natalia Tatiana Svetlana Andrei Mohammed Ahmed Fatima Omar Aisha Hassan Wei Ling Hiroshi Yuki Kenji "
    "Priya Raj Anil Sanjay Deepa Chen Min Jin Kwame Amara Chidi Ngozi Björn Lars Ingrid Astrid Erik Piotr Katarzyna Zofia Jan Pedro João Beatriz Sofia Elena Nikos Maria"
).split()
# Words by which the context labelers know a kind, or something else.
MAIL_WORDS = "(?:e-?)?mails?|to|mailto|mailed|contact|write|written|cc|bcc|from|sender|recipient|reply|notify|invite|address|author|user|account|signed up|reach"
REMOTE_WORDS = "ssh|scp|sftp|rsync|git|clone|mosh|pull|push|remote|fetch|svn|hg"
LOGINS = frozenset("git root deploy ubuntu admin hg svn ec2-user postgres www-data sync".split())
PHONE_WORDS = "call|called|calls|calling|tel|telephone|phone|fax|reach|text|number|mobile|cell|sms|dial|ring|whatsapp|contact|hotline|handy|telefon|téléphone|teléfono|móvil"
ID_WORDS = (
    "passport|ssn|social security|social insurance|social|tax|national|identity|insurance|personalausweis|ausweis|steuer\\w*|reisepass|dni|nie|nif|cpf|cnpj|rg|curp|rfc|aadhaar|pan|sin|nino|ni|nhs|"
    "personnummer|bsn|pesel|codice fiscale|driver'?s?|driving|licen[cs]es?|id|id-?card|identification|tin|itin|kyc|numéro fiscal|permis|passeport|pasaporte"
)
OTHER_WORDS = (
    "order|orders|run|runs|build|rows?|version|v|release|timeout|uuid|guid|commit|ticket|issue|pr|port|shard|ip|host|pid|process|line|lines|page|chapter|section|error|code|status|exit|size|offset|bytes?|"
    "count|total|sum|batch|job|task|queue|seed|seq|epoch|step|sku|invoice|tracking|isbn|serial|model|part|price|amount|balance|date|time|timestamp|at|between|kill|chmod|sleep|listen|bind|revision|rev|tag|hash"
)
COUNT_WORDS = "runs|tries|attempts|cases|items|rows|requests|times|ms|milliseconds|seconds|secs?|s|minutes|min|hours|days|bytes|kb|mb|gb|passed|failed|percent|lines|files|events|records|users|tests|points"
PLACE_WORDS = "moved? to|lives?|living|address(?:ed)?|office|ship(?:ped|ping)?|deliver(?:ed|y)?|visit|post|send|sent|parcel|letter|mail|to|at|residing|located|reside|home|house|wohnt|habite|vive"
NAME_WORDS = (
    "my name is|name is|i am|i'm|named|author|authors|reviewer|reviewed|reviewed-by|reported-by|signed-off-by|co-authored-by|tested-by|cc|hi|hello|hey|dear|thanks|thank you|thx|regards|cheers|ask|asked|ping|by|from|with|"
    "client|customer|colleague|manager|user|owner|assignee|assigned to|contact|patient|employee|candidate|subject|signed|sincerely|told|tell|met|meet|says|said|who|for|call|called|invite|attn"
)
TITLES = "Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Herr|Frau|Señora|Señor|Sra|Sr|Mme|Mlle|Monsieur|Madame|Sir|Dame"
AFTER_NAME = "said|says|wrote|writes|asked|asks|owns|reviewed|reported|signed|complained|called|joined|left|replied|thinks|wants|agreed|lives|works|will|has|is out|was|and i\\b|can"
THINGS = (
    "packages?|scripts?|builds?|modules?|crates?|librar(?:y|ies)|compilers?|code|languages?|frameworks?|servers?|services?|apis?|class(?:es)?|functions?|repos?|repositor(?:y|ies)|branch(?:es)?|plugins?|tools?|"
    "files?|folders?|sections?|projects?|teams?|tests?|jobs?|pipelines?|tables?|queries|query|databases?|clusters?|nodes?|ports?|tags?|versions?|releases?|docs?|pages?|hooks?|workers?|keys?|labels?"
)
# Words that begin a sentence with a capital and are no part of a name.
FUNCTION_WORDS = frozenset(
    "the a an this that these those each every any some all both no one two another my your his her its our their it we you they he she i if when while as as_long once after before until unless although though whereas whenever since because "
    "given even so but and or nor yet for in on at to from by with of into over under about between through during without within please note see ask hi hello hey dear thanks thank cc bcc re fwd regards cheers call text tel phone fax ping reach contact "
    "who what which where why how is are was were be been do does did can could should would will may might must not never always then than there here now today tomorrow yesterday also just only still last next first second "
    "monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december ok todo fixme eof eta".split()
)


def _pair(template: str, flags: int = 0):
    """A pattern for ASCII texts and one for all others: ``{U}`` is an upper-case letter, ``{L}`` any."""
    return re.compile(template.replace("{U}", "A-Z").replace("{L}", "A-Za-z"), flags), regex.compile(template.replace("{U}", r"\p{Lu}").replace("{L}", r"\p{L}\p{M}"), flags)


EMAIL = _pair(
    r"(?<![{L}0-9._%+-])[{L}0-9][{L}0-9._%+'-]*(?:@|%40|\s?[\[(]\s?at\s?[\])]\s?)[{L}0-9-]+(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?)[{L}0-9-]+)+|\b[{L}0-9][{L}0-9._+-]* at [{L}0-9-]+(?: dot [{L}0-9-]+)+\b",
    re.I,
)
PHONE = _pair(r"(?<![{L}0-9_.@/:#-])(?:\+|\()?\d(?:[ ().\-/]{0,3}\d){6,14}(?:\s?(?:ext\.?|x)\s?\d{1,5})?(?![{L}0-9_/:@]|[.-]\d)", re.I)
# Forms of numbers of identity documents: groups of digits (social security, tax, health, identity), digits with check letters, passports and licences.
NUMBER = _pair(
    r"(?<![{L}0-9_.@/#+-])(?:\d{3}[- ]\d{2}[- ]\d{4}|\d{3}[- ]\d{3}[- ]\d{3}|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{4} \d{4} \d{4}|\d{2,3}/\d{3,4}/\d{4,5}|\d{6}[-+]\d{4}|\d{2} \d{3} \d{3} \d{3}|[12] ?\d\d ?\d\d ?\d\d ?\d{3} ?\d{3}(?: ?\d\d)?"
    r"|[{U}]{2}[ -]?\d\d[ -]?\d\d[ -]?\d\d[ -]?[{U}]|[{U}]?-?\d{7,8}-?[{U}]|[{U}]{6}\d\d[{U}]\d\d[{U}]\d{3}[{U}]|[{U}][{L}'’]{1,7}\d{6}[{L}\d]{2,5}|[{U}]\d{2}[{U}]\d{2}[{U}]\d{2}|[{U}]{1,2}[ -]?\d(?:[ -]?\d){5,8}|\d{9,12})(?![{L}0-9_]|[-/.]\d)"
)
OWN_FORM = _pair(r"\d{3}-\d\d-\d{4}|\d{3}\.\d{3}\.\d{3}-\d\d|[{U}]{2} ?\d\d ?\d\d ?\d\d ?[{U}]|\d{8}-?[{U}]|[{U}]-?\d{7}-?[{U}]|[{U}]{6}\d\d[{U}]\d\d[{U}]\d{3}[{U}]|\d{6}[-+]\d{4}|\d{2,3}/\d{3,4}/\d{5}")
_STREET = "street|st|lane|ln|drive|dr|road|rd|avenue|ave|court|ct|close|way|square|sq|terrace|crescent|boulevard|blvd|place|row|hill|gardens|parkway|highway"
ADDRESS = _pair(
    rf"(?<![{{L}}0-9_.:/-])(?:\d{{1,5}}(?:[ -]?[{{L}}])?,? (?:[{{L}}][{{L}}.'’-]*\s){{1,4}}?(?:{_STREET})\b"
    r"|p\.? ?o\.? ?box \d+|\d{1,4}(?: ?bis| ?ter)?,? (?:rue|avenue|chemin|place|quai|boulevard|allée)\s(?:(?:de|du|des|la|le|l')\s?)*[{L}'’-]+(?:\s[{L}'’-]+)?"
    r"|(?:calle|avenida|plaza|paseo|via|viale|piazza|corso|rua|carrer|rue)\s(?:(?:de|del|da|do|dos|la|las|los)\s)*[{L}'’-]+(?:\s[{L}'’-]+)?,? \d+|[{L}]+(?:stra(?:ß|ss)e|str\.|allee|weg|gasse|platz|damm|ufer|straat|gatan)\s\d{1,4}\b)"
    r"(?:(?:,\s?|\s)(?:apt|apartment|flat|unit|suite|floor|piso|2º|\dº)[ .]?[{L}0-9.º]*(?:\s(?:izq|der|dcha)\.?)?)?",
    re.I,
)
CAP = r"[{U}][{L}'’]*[{L}](?:-[{U}][{L}]+)*"
TOWN = _pair(rf"(?:[,\n]\s?(?:\d{{4,5}} )?{CAP}(?: {CAP})?)?(?:[,\n]?\s?[A-Z]{{1,2}}\d{{0,2}}[A-Z]? ?\d[\dA-Z]{{2,4}}\b)?")
NAME = _pair(rf"(?<![{{L}}0-9_@#/.\-=])(?:(?:{TITLES})\.? )?(?:[{{U}}]\. )?{CAP}(?:,? (?:[{{U}}]\. )?(?:(?:van|von|de|der|den|da|di|la|del|el|bin|al|ten) )*{CAP}){{0,4}}(?![{{L}}0-9_/=(]|\.[{{L}}0-9]|@)")
WORD = _pair(r"[{L}0-9'’-]+")
CAPS = _pair(rf"(?:[{{U}}]\.|{CAP})")
#: Where a given or family name stands, whatever the name: learning looks at these places.
PLACES = _pair(
    rf"(?:\b(?:my name is|signed-off-by:|reviewed-by:|reported-by:|co-authored-by:|tested-by:|authors?[:=]|cc:|hi|hello|hey|dear|thanks,?|regards,|cheers,|(?:{TITLES})\.?)) \"?({CAP})(?: ({CAP}))?"
    .replace("my name is", "[Mm]y name is").replace("signed-off", "[Ss]igned-off").replace("reviewed-by", "[Rr]eviewed-by").replace("reported-by", "[Rr]eported-by").replace("co-auth", "[Cc]o-[Aa]uth")
    .replace("|authors?", "|[Aa]uthors?").replace("cc:", "[Cc]c:").replace("|hi|hello|hey|dear|thanks,?|regards,|cheers,", "|[Hh]i|[Hh]ello|[Hh]ey|[Dd]ear|[Tt]hanks,?|[Rr]egards,|[Cc]heers,")
    + rf"|({CAP}) ({CAP}) <[^<>@\s]+@"
)


def folded(text: str) -> str:
    """Full-width forms, dashes and blanks as plain ones, position by position, so that spans hold for the given text."""
    if text.isascii():
        return text
    out = []
    for c in text:
        if unicodedata.category(c) == "Pd":
            c = "-"
        elif c != "\n" and c.isspace():
            c = " "
        elif "！" <= c <= "～":
            c = chr(ord(c) - 0xFEE0)
        out.append(c)
    return "".join(out)


@lru_cache(100_000)
def bucket(word: str) -> int:
    plain = word.lower() if word.isascii() else "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)).casefold()
    return zlib.crc32(plain.encode()) % BUCKETS


@lru_cache(256)
def _near(words: str, gap: int = 18) -> re.Pattern:
    """One of the words, then at most a few characters that are no end of a sentence, up to the span."""
    return re.compile(rf"(?<![^\W_])(?:{words})(?!\w)(?:no\. |(?![.!?;]\s)[^\n]){{0,{gap}}}\Z", re.I)


@lru_cache(256)
def _next_to(words: str) -> re.Pattern:
    return re.compile(rf"(?<!\w)(?:{words})(?!\w)[:=,]?\s?[\"'(<]{{0,2}}\Z", re.I)


@lru_cache(256)
def _after(words: str) -> re.Pattern:
    return re.compile(rf"\s(?:{words})(?!\w)", re.I)


_COUNTED = re.compile(rf"\s(?:in \w+ )?(?:{COUNT_WORDS})(?!\w)", re.I)
_THING = re.compile(rf"\s(?:and (?:the )?[A-Z]\w+ )?(?:{THINGS})(?!\w)")
_ORDINARY = re.compile(r"(?<![\w-])(?:and|of|the|in|is|are|a|to|for|that|this|was|has)(?!\w)", re.I)
_POSTCODE = re.compile(r"\b\d{5}\b|\b[A-Z]{1,2}\d{1,2}[A-Z]? ?\d[A-Z]{2}\b|\b\d{4} ?[A-Z]{2}\b")
_NORTH = re.compile(r"(?:\+?1[-. ]?)?\(?\d{3}\)?[-. ]\d{3}[-. ]\d{4}|\d{3}-\d{4}|\(?0\d{2,4}\)?[ -]\d{3,4}[ -]?\d{3,4}|0\d(?: \d\d){4}")
_DATE = re.compile(r"(?:19|20)\d\d[-./]?\d\d[-./]?\d\d(?:[- ]\d+)?|\d{1,2}[./-]\d{1,2}[./-](?:19|20)?\d\d|\d{1,3}(?:\.\d{1,3}){3}|\d+(?:\.\d+){2,}")
_SHAPE = str.maketrans({**{c: "9" for c in "0123456789"}, **{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}})


class WordStats:
    """Hashed counts over a whole table: in how many texts a word stands in a name's place, and in lower case."""

    def __init__(self, named: np.ndarray, lower: np.ndarray, given_names):
        self.named, self.lower, self.given = named, lower, frozenset(map(bucket, given_names))

    def known(self, word: str, least: int = 3) -> bool:
        b = bucket(word)
        return b in self.given or bool(self.named[b] >= least and self.named[b] > self.lower[b])

    def ordinary(self, word: str) -> bool:
        b = bucket(word)
        return bool(self.lower[b] > 2 + 2 * self.named[b])


def learn_words(texts: DataFrame, given_names=tuple(GIVEN_NAMES)) -> WordStats:
    """The statistics of all texts of a table's first column: two counts for each of ``BUCKETS`` hashed words reach the driver, whatever the table."""
    column = texts.columns[0]

    def count(batches):
        named, lower = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        small = re.compile(r"(?<![\w@#/.+-])[a-z]{3,}\b(?![@＠%(\[]|[.+-]\w| at )")
        for batch in batches:
            seen: dict[str, int] = {}
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                for word in set(small.findall(text)):
                    seen[word] = seen.get(word, 0) + 1
                if not any(c in text for c in CUES):
                    continue
                places = PLACES[not text.isascii()]
                for b in {bucket(w) for m in places.finditer(folded(text)) for w in m.groups() if w and w.lower() not in FUNCTION_WORDS}:
                    named[b] += 1
            for word, n in seen.items():
                lower[bucket(word)] += n
        at = np.flatnonzero(named | lower)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(named[at]), pa.array(lower[at])], names=["b", "named", "lower"])

    found = texts.select(column).mapInArrow(count, "b bigint, named bigint, lower bigint").groupBy("b").agg(F.sum("named").alias("named"), F.sum("lower").alias("lower")).toPandas()
    named, lower = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    named[found["b"].to_numpy(np.int64)], lower[found["b"].to_numpy(np.int64)] = found["named"], found["lower"]
    return WordStats(named, lower, given_names)


def _mails(text, n):
    for m in EMAIL[n].finditer(text):
        a, b = m.span()
        local, tail = re.split("@|%40|[\\[( ]", m[0])[0].lower(), re.findall(r"[\w-]+", m[0])[-1]
        good = tail.isalpha() and len(tail) > 1
        command = re.split(r"[|;&\n]|(?<=[.!?]) ", text[max(0, a - 60) : a])[-1]
        remote = bool(re.search(rf"(?<![\w-])(?:{REMOTE_WORDS})\s(?!send-email|.*author|.*config|.*commit|.*format-patch)", command, re.I)) or bool(re.match(r":[\w/~.]", text[b : b + 2]))
        yield a, b, (
            1 if good else -1,
            -1 if remote else 1 if good else 0,
            -1 if local in LOGINS else 0,
            1 if _near(MAIL_WORDS).search(text[max(0, a - 44) : a]) or text[a - 1 : a] in ("<", ":", "=") else 0,
            -1 if re.search(r"(?:@|%40)\d", m[0]) else 0,
            1 if re.search(r"[._+\d-]", local) or len(local) > 6 else 0,
        )


def _addresses(text, n):
    for m in ADDRESS[n].finditer(text):
        a, b = m.span()
        rest = TOWN[n].match(text, b)
        end = rest.end() if rest else b
        head = re.search(r"(?:flat|apt|unit|suite)\s\w+,\s$", text[max(0, a - 14) : a], re.I)
        a -= len(head[0]) if head else 0
        after, words = text[b : b + 40], re.findall(r"[^\W\d_]+", m[0])
        yield a, end, (
            1 if _near(PLACE_WORDS).search(text[max(0, a - 44) : a]) else 0,
            1 if re.match(r"[,\n]\s?(?:\d|[^\W\d_])", after) else -1,
            1 if re.search(r"\bp\.? ?o\.? ?box|bis |º|\bapt|\bflat|\bunit", text[a:b], re.I) or head else 0,
            1 if _POSTCODE.search(after) else 0,
            -1 if _ORDINARY.search(m[0]) else 1,
            1 if words and sum(w[0].isupper() for w in words) * 2 >= len(words) else -1,
        )


def _numbers(text, n):
    for m in NUMBER[n].finditer(text):
        a, b = m.span()
        before = text[max(0, a - 34) : a]
        named = bool(re.search(rf"(?<![\w])(?:{ID_WORDS})(?![\w])[^!?]{{0,18}}\Z", before, re.I))
        other = bool(_COUNTED.match(text, b)) or bool(_near(OTHER_WORDS, 8).search(text[max(0, a - 22) : a]))
        form = OWN_FORM[n].fullmatch(m[0])
        yield a, b, (
            1 if named else -1,
            1 if form else 0,
            -1 if other and not named else 0,
            -1 if not named and _near(PHONE_WORDS).search(text[max(0, a - 24) : a]) else 0,
            -1 if not named and (text[a - 1 : a] == "=" or re.match(r"[A-Z]{2,3}-\d", m[0])) else 0,
            -1 if not named and (_NORTH.fullmatch(m[0]) or _DATE.fullmatch(m[0]) or m[0].isdigit()) else 0,
        )


def _phones(text, n):
    for m in PHONE[n].finditer(text):
        a, b = m.span()
        groups = re.split(r"\s?(?:ext\.?|x)", m[0], flags=re.I)[0]
        north, world, date = _NORTH.fullmatch(groups), re.match(r"\+\d|00[1-9]\d", groups), _DATE.fullmatch(groups)
        before = text[max(0, a - 34) : a]
        other = bool(_COUNTED.match(text, b)) or bool(_near(OTHER_WORDS, 8).search(text[max(0, a - 20) : a]))
        named = bool(re.search(rf"(?<![\w])(?:{ID_WORDS})(?![\w])[^!?]{{0,18}}\Z", before, re.I))
        cue = bool(_near(PHONE_WORDS).search(text[max(0, a - 44) : a]))
        yield a, b, (1 if world else 0, 0 if world or (north and "." in groups and not cue) else 1 if north else -1, 1 if cue and not named else 0, -1 if (other and not cue) or date else 1, 1 if groups != m[0] or "(" in m[0] else 0, -1 if named and not world else 0)


def _names(text, n, words: WordStats):
    for m in NAME[n].finditer(text):
        found, at = m[0], m.start()
        if " " not in found and (at == 0 or text[at - 1] == "\n" or text[at - 2 : at] in (". ", "! ", "? ")) and not words.known(found):
            continue  # the first word of a sentence that is no name elsewhere
        title = re.match(rf"(?:{TITLES})\.? ", found)
        runs, run = [], []
        for w in CAPS[n].finditer(found, title.end() if title else 0):
            if w[0].lower() in FUNCTION_WORDS:
                runs.append(run)
                run = []
            else:
                run.append((w.start(), w.end(), w[0]))
        for run in (*runs, run):
            if not run:
                continue
            a, b = at + run[0][0], at + run[-1][1]
            parts = [w for _, _, w in run if not w.endswith(".")]
            if not parts or all(len(p) < 5 and p.isupper() for p in parts):
                continue
            titled = bool(title) and run[0][0] == title.end()
            before, after = text[max(0, a - 26) : a], text[b : b + 24]
            shown = before.rstrip(" \"'(*_>")
            first = a == 0 or not shown or shown[-1] in ".!?\n" or before.endswith("\n")
            known = [words.known(p) for p in parts]
            cue = bool(_next_to(NAME_WORDS).search(before)) or after.startswith(" <")
            follows, thing = bool(_after(AFTER_NAME).match(after)), bool(_THING.match(after))
            if len(parts) == 1 and first and not (titled or known[0] or (cue and not words.ordinary(parts[0]))):
                continue
            a = at if titled else a
            yield a, b, (
                1 if (titled or any(known)) and not thing else 0,
                1 if titled or any(w.endswith(".") for _, _, w in run) else 0,
                1 if cue else 0,
                1 if follows else 0,
                -1 if thing else 0,
                1 if len(parts) > 1 and any(known) else 0,
                -1 if any(map(words.ordinary, parts)) else 0,
                -1 if first and not cue else 0,
                1 if len(parts) > 1 and not first and not any(map(words.ordinary, parts)) else 0,
                -1 if (not any(known) and any(map(str.isupper, parts))) or any(re.search(r"[a-z][A-Z]", p) for p in parts) else 0,
            )


# What a text must hold for the costlier patterns to be tried at all; each of their matches holds one of these.
_DIGIT, _DIGITS = re.compile(r"[0-9]"), re.compile(r"[0-9](?:[^\n]{0,3}[0-9]){4}")
STREETS = (*(f" {w}" for w in _STREET.split("|")), "box", "rue", "chemin", "quai", "allée", "boulevard", "calle", "avenida", "plaza", "paseo", "via", "piazza", "corso", "rua", "carrer", "stra", "str.", "allee", "weg", "gasse", "platz", "damm", "ufer", "gatan")
CUES = ("y name is", "-by:", "uthor", "c: ", "Hi ", " hi ", "ello ", "Hey ", " hey ", "Dear", "dear ", "hanks", "egards,", "heers,", "> ", "@", *(f"{t.rstrip('?')}" for t in TITLES.split("|")))


def candidates(text: str, words: WordStats):
    """(kind, start, end, votes) of every span that any pattern proposes, overlapping ones too; a vote is 1, 0 or -1."""
    text = folded(text)
    n = not text.isascii()
    out = []
    if "@" in text or "%40" in text or "(at" in text or "[at" in text or (" at " in text and " dot " in text) or "at )" in text:
        out += [("email", *c) for c in _mails(text, n)]
    if _DIGIT.search(text):
        low = text.lower()
        if any(w in low for w in STREETS):
            out += [("address", *c) for c in _addresses(text, n)]
        if _DIGITS.search(text):
            out += [("id_number", *c) for c in _numbers(text, n)] + [("phone", *c) for c in _phones(text, n)]
    mails = [(a, b) for kind, a, b, _ in out if kind == "email"]
    return out + [("name", a, b, votes) for a, b, votes in _names(text, n, words) if not any(c < b and a < d for c, d in mails)]


def features(text: str, kind: str, start: int, end: int) -> list[int]:
    """Hashed features of a span and its context: its shape, its words, the words and characters around it."""
    n = not text.isascii()
    span, left, right = text[start:end], WORD[n].findall(text[max(0, start - 50) : start])[-4:], WORD[n].findall(text[end : end + 40])[:3]
    shape = span.translate(_SHAPE)
    left, right = [w.lower() for w in left], [w.lower() for w in right]
    line = start == 0 or text[start - 1] == "\n"
    found = [f"c:{text[start - 1 : start]}", f"d:{text[end : end + 1]}", f"line:{line}", *(f"l:{w}" for w in left), *(f"r:{w}" for w in right), *(f"l{i}:{w}" for i, w in enumerate(left[::-1][:2])), *(f"r{i}:{w}" for i, w in enumerate(right[:2]))]
    if kind in ("phone", "id_number"):
        found += [f"s:{shape}", f"s:{re.sub('9+', '9', shape)}"]
    elif kind == "name":
        found += [f"s:{re.sub('(?<=A)a+', 'a', shape)}"]
    elif kind == "address":
        found += [f"w:{w.lower()}" for w in WORD[n].findall(span)[-3:]]
    return [zlib.crc32(f"{kind}|{x}".encode()) % BUCKETS for x in found]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("votes", T.ArrayType(T.ByteType())), T.StructField("features", T.ArrayType(T.IntegerType()))]))


def propose(df: DataFrame, text_col: str, words: WordStats, spans: str = "_spans") -> DataFrame:
    """``df`` with the candidate spans of each text, their votes and features: found once, for learning and for deciding."""
    broadcast = df.sparkSession.sparkContext.broadcast(words)
    schema = T.StructType([*[f for f in df.schema if f.name != spans], T.StructField(spans, SPANS)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.list_(pa.int8())), ("features", pa.list_(pa.int32()))]))

    def find(batches):
        stats = broadcast.value
        for batch in batches:
            rows = []
            for text in batch.column(text_col).to_pylist():
                plain = folded(text or "")
                rows.append([{"kind": k, "start": a, "end": b, "votes": list(v), "features": features(plain, k, a, b)} for k, a, b, v in candidates(plain, stats)] if plain else [])
            kept = [c for c in batch.schema.names if c != spans]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(rows, kind)], names=[*kept, spans])

    return df.mapInArrow(find, schema)


def weigh(patterns: dict[tuple[int, ...], int], rounds: int = 100, strength: float = 1.0) -> np.ndarray:
    """Expectation-maximisation (Dawid and Skene's model) over vote patterns and their counts.

    Gives the log odds that each vote adds (a row for each labeler: of -1, 0 and 1), and in the last row those before
    any vote. It starts from the majority of votes. The prior on a labeler's reliability has the weight of ``strength``
    times the spans, so the result does not depend on their number; with less of it, tables of a few hundred spans
    settle on other classes.
    """
    votes, n = np.array(list(patterns)), np.array(list(patterns.values()), float)
    likely, weight = 1 / (1 + np.exp(-1.6 * votes.sum(1))), strength * n.sum()
    odds = np.zeros((votes.shape[1] + 1, 3))
    for _ in range(rounds):
        for y, share in ((1, likely), (0, 1 - likely)):
            mass, sign = n * share, 1 if y else -1
            log = np.zeros_like(odds)
            log[-1] = np.log((mass.sum() + 0.05 * n.sum()) / (1.1 * n.sum()))
            for j in range(votes.shape[1]):
                for v in (-1, 0, 1):
                    prior = 0.4 if v == 0 else 0.5 if (v == 1) == bool(y) else 0.1
                    log[j, v + 1] = np.log((mass[votes[:, j] == v].sum() + prior * weight) / (mass.sum() + weight))
            odds = sign * log if y else odds + sign * log
        likely = 1 / (1 + np.exp(-np.clip(_odds(odds, votes), -50, 50)))
    return odds


def _odds(odds: np.ndarray, votes: np.ndarray) -> np.ndarray:
    return odds[np.arange(len(odds) - 1)[None], votes + 1].sum(axis=1) + odds[-1, 0]


class Classifier:
    """Per kind the log odds of a span: those of its votes, and those that its shape, words and context add.

    A span that no labeler votes for starts from ``UNVOTED`` at most, so that only a telling context makes it count.
    """

    UNVOTED, MIX, MOST = -1.5, 0.5, 4.0

    def __init__(self, odds: dict[str, np.ndarray], hashed: np.ndarray):
        self.odds, self.hashed, self._known = odds, hashed, {}

    def of_votes(self, kind: str, votes: tuple[int, ...]) -> float:
        if (kind, votes) not in self._known:
            value = float(_odds(self.odds[kind], np.array([votes]))[0]) if kind in self.odds else float(sum(votes))
            self._known[kind, votes] = value if max(votes) > 0 else min(value, self.UNVOTED)
        return self._known[kind, votes]

    def score(self, kind: str, votes, found) -> float:
        context = float(self.hashed[np.asarray(found, np.int64)].sum())
        return self.of_votes(kind, tuple(int(v) for v in votes)) + self.MIX * max(-self.MOST, min(self.MOST, context))

    def chosen(self, spans) -> list[tuple[int, int, str]]:
        """Accepted spans in order, without overlaps: an earlier start, then the longer one, then the surer one wins."""
        scored = [(s["start"], -s["end"], -self.score(s["kind"], s["votes"], s["features"]), s["kind"]) for s in spans]
        out, end = [], 0
        for a, b, score, kind in sorted(x for x in scored if x[2] < 0):
            if a >= end:
                out.append((a, -b, kind))
                end = -b
        return out


def fit(proposed: DataFrame, spans: str = "_spans", max_samples: int = 8_000, rounds: int = 80, restraint: float = 20.0) -> Classifier:
    """The span classifier, from the votes on all candidate spans.

    Counts of vote patterns over all texts go to the driver (3 to the number of labelers for each kind at most); there
    expectation-maximisation weighs the labelers. With the resulting probabilities as labels a logistic model on hashed
    features of span and context (no votes) is trained on at most ``max_samples`` spans of each kind, those first by a
    hash of their place and words. A kind that no span is proposed for is decided by the majority of votes.
    """
    each = proposed.select(F.explode(spans).alias("s")).select("s.*")
    counts = each.groupBy("kind", F.array_join(F.col("votes").cast("array<string>"), ",").alias("v")).agg(F.count(F.lit(1)).alias("n")).collect()
    patterns: dict[str, dict[tuple[int, ...], int]] = {}
    for r in sorted(counts, key=lambda r: (r.kind, r.v)):
        patterns.setdefault(r.kind, {})[tuple(map(int, r.v.split(",")))] = r.n
    # What no labeler votes for is held to be nothing, and left to the context.
    voted = {kind: {v: n for v, n in found.items() if max(v) > 0} for kind, found in patterns.items()}
    model = Classifier({kind: weigh(found) for kind, found in voted.items() if found}, np.zeros(BUCKETS))
    order, share = F.xxhash64("features", "start"), F.lit(0.0)
    for kind, found in patterns.items():
        share = F.when(F.col("kind") == kind, min(1.0, 1.2 * max_samples / sum(found.values()))).otherwise(share)
    sample = each.where(F.pmod(order, F.lit(1 << 20)) <= share * (1 << 20)).withColumn("_n", F.row_number().over(Window.partitionBy("kind").orderBy(order, "start", "features"))).where(F.col("_n") <= max_samples)
    rows = sample.select("kind", "votes", "features", "start").collect()
    for kind in patterns:
        part = sorted((r for r in rows if r.kind == kind), key=lambda r: (r.features, r.start, r.votes))
        y = np.array([1 / (1 + np.exp(-max(-30.0, min(30.0, model.of_votes(kind, tuple(r.votes)))))) for r in part])
        place = np.repeat(np.arange(len(part)), [len(r.features) for r in part])
        used, at = np.unique(np.concatenate([np.asarray(r.features, np.int64) for r in part]), return_inverse=True)
        seen, h = np.bincount(at, minlength=len(used)), np.zeros(len(used))
        base = np.log((y.mean() + 0.01) / (1.01 - y.mean()))
        for _ in range(rounds):  # rare words are held near zero by the restraint
            p = 1 / (1 + np.exp(-np.clip(base + np.bincount(place, h[at], minlength=len(y)), -30, 30)))
            h -= 0.5 * (np.bincount(at, (p - y)[place], minlength=len(used)) + restraint * h) / (2.5 * seen + restraint)
        model.hashed[used] += h
    return model


def redact(proposed: DataFrame, text_col: str, classifier: Classifier, redacted: str = "redacted", kinds: str = "kinds", spans: str = "_spans") -> DataFrame:
    """Texts with ``[KIND]`` in place of each piece of personal data, and the sorted array of the kinds found.

    All else stays character for character. A null text gives null and no kinds, an empty one stays empty. Repeated rows
    stay. A column named like a result column is replaced. A map over rows without shuffle.
    """
    shared = proposed.sparkSession.sparkContext.broadcast(classifier)

    @F.pandas_udf("redacted string, kinds array<string>")
    def mask(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        model, out, sorts = shared.value, [], []
        for text, each in zip(texts, found):
            chosen = model.chosen(each) if each is not None and len(each) else []
            parts, at = [], 0
            for a, b, kind in chosen:
                parts += [text[at:a], f"[{kind.upper()}]"]
                at = b
            out.append(None if text is None else "".join(parts) + text[at:])
            sorts.append(sorted({k for _, _, k in chosen}))
        return pd.DataFrame({"redacted": out, "kinds": sorts})

    # Texts without candidates stay in the JVM.
    has = F.size(spans) > 0
    masked = proposed.withColumn("_masked", mask(F.when(has, F.col(text_col)), F.when(has, F.col(spans))))
    return masked.withColumns({redacted: F.when(has, F.col("_masked.redacted")).otherwise(F.col(text_col)), kinds: F.col("_masked.kinds")}).drop("_masked", spans)


def fit_on(df: DataFrame, text_col: str, given_names=tuple(GIVEN_NAMES)) -> tuple[WordStats, Classifier]:
    """Statistics and classifier of a table, for ``redact_with`` on others."""
    words = learn_words(df.select(text_col), given_names)
    return words, fit(propose(df.select(text_col), text_col, words).checkpoint())


def redact_with(df: DataFrame, text_col: str, words: WordStats, classifier: Classifier, redacted: str = "redacted", kinds: str = "kinds") -> DataFrame:
    return redact(propose(df, text_col, words), text_col, classifier, redacted, kinds)


def redact_texts(df: DataFrame, text_col: str, given_names=tuple(GIVEN_NAMES), redacted: str = "redacted", kinds: str = "kinds") -> DataFrame:
    """``redact`` with statistics, candidates and classifier of the table itself. Candidates are written once and read for learning and for deciding."""
    given = df.withColumn(text_col, F.col(text_col).cast("string"))
    words = learn_words(given.select(text_col), given_names)
    proposed = propose(given, text_col, words).checkpoint()
    return redact(proposed, text_col, fit(proposed), redacted, kinds)
