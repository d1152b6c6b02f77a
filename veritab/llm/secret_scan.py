"""Operator 9: secret scan with a password guess-cost dynamic programme."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK, col, python_ready

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a whole run of 20 or more
HEX = re.compile(r"[0-9a-f]{24,}")
#: A text without any of these, lower-cased, has no match of ASSIGN.
ASSIGN_STEMS = ("password", "passwd", "secret", "token", "apikey", "api_key")
BASE_KINDS = ("assign", "access", "hex")

#: Contexts whose value the guess cost judges: a credential's name (with any
#: parts behind it) and a colon or an equals sign, an authorization scheme, the
#: password part of an URL. A quoted value ends at the same quote; without a
#: pair of quotes a value ends at white space, a quote or an angle bracket.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|credentials?|cred|auth(?:orization)?|login"""
    r"""|(?:api|access|private|client|signing|encryption)[_-]?(?:key|secret|token))(?:[_-][a-z0-9]+)*+["']?[\x20\t]*+(?:=>|:=|[:=])[\x20\t]*+"""
    r"""(?:(?:bearer|basic)[\x20\t]++)?(?:"([^"\s]{6,})"|'([^'\s]{6,})'|["']?([^\s"'<>]{6,}))"""
    r"""|\bbearer[\x20\t]++([^\s"'<>]{6,})|://[^\s/:@]*+:([^\s/@]{6,})@"""
    r"""|\b(?:pin|pass[_-]?code)["']?[\x20\t]*+(?:=>|[:=])[\x20\t]*+["']?([0-9]{4,5})(?![^\s"'<>.,;:!?)\]}])""",
    re.IGNORECASE | re.ASCII)
#: The groups of CONTEXT with quoted values, and with numbers of four or five digits.
QUOTED, SHORT_PIN = (1, 2), 6
#: What follows a value without white space in between: another name with its value.
NEXT_NAME = re.compile(r"""[,;&]["']?[a-z_][\w.-]*+["']?(?:=>|[:=])""", re.IGNORECASE | re.ASCII)
CONTEXT_STEMS = ("pass", "pwd", "pin", "secret", "token", "cred", "auth", "login", "key", "bearer", "://")
#: Bits of guessing work from which a value is a secret, whatever its length.
MIN_BITS = 40.0
#: A value with fewer bits is one as well when no way to guess it costs less
#: than this share of brute force.
NEAR_BRUTE = 0.85
#: How many of the corpus's most frequent words the dictionary holds.
DICTIONARY_WORDS = 4096
MAX_WORD = 24

# The most common passwords, in their usual order.
COMMON = ("password 123456 qwerty letmein admin welcome monkey dragon master login abc123 iloveyou football baseball "
          "sunshine princess shadow superman michael trustno1 passw0rd hello freedom whatever secret changeme test "
          "guest root default example user demo sample temp none null true false your here token key value").split()
# Frequent letter pairs of European languages, frequent ones first, for corpora with few words.
PAIRS = ("th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa si ar ve ra ld "
         "ur ch ei ie un ge be sc ic di da ne li me el la ma ri ro co ta no us tr il ss ll ec om ce ho ac io pr pe ca qu ue "
         "ui ut im em am ad id od up op ap po pa pl sh wh wo ow ke ck ki gh ht ly ry ty ay ey fo fi fe fa ff ee oo so mo mi "
         "mu su lu ru do du lo ol ul vi va bl br bo ba bu cr cl cu ct rt rs ns ls ts nc ir im ab ag ig").split()
# The rows of a keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")


def _neighbours() -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    for y, row in enumerate(ROWS):
        for x, key in enumerate(row):
            near[key] = {ROWS[b][a] for b in (y - 1, y, y + 1) if 0 <= b < len(ROWS)
                         for a in (x - 1, x, x + 1) if 0 <= a < len(ROWS[b]) and (a, b) != (x, y)}
    return near


NEAR = _neighbours()
DATE = re.compile(r"(?:19|20)\d\d([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"
                  r"|(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d"
                  r"|(?:0[1-9]|1[0-2])([-/.]?)(?:0[1-9]|[12]\d|3[01])\3(?:19|20)\d\d")
YEAR = re.compile(r"(?:19|20)\d\d")
LETTERS = re.compile(r"[^\W\d_]+")
#: Bits for a word that the dictionary lacks: a language has about a million.
UNKNOWN_BITS = 20.0
DATE_BITS, YEAR_BITS = math.log2(366 * 120), math.log2(120)
#: Repeats up to this period are tried at every place, longer ones are looked up.
SHORT_PERIOD = 8
#: Bits for telling where a segment ends and of which sort it is.
SEGMENT_BITS = 2.0


def _char_bits(ch: str) -> float:
    if "0" <= ch <= "9":
        return math.log2(10)
    if ch.isalpha():
        return math.log2(26) if ch.isascii() else math.log2(100)
    return math.log2(33)


def _letter_runs(value: str) -> Iterator[tuple[int, int]]:
    """Where runs of four or more letters are, cut before a capital that follows a small letter."""
    for m in LETTERS.finditer(value):
        cuts = [k for k in range(m.start() + 1, m.end()) if value[k].isupper() and value[k - 1].islower()]
        for i, j in zip([m.start(), *cuts], [*cuts, m.end()]):
            rest = value[i + 1:j]
            if j - i >= 4 and (rest.islower() or value[i:j].isupper()):
                yield i, j


class GuessCost:
    """The cheapest way to guess a value, in bits: a segmentation into words
    (cost by rank), dates, repeats, keyboard walks, alphabetical or numerical
    runs, and brute force (cost by character class)."""

    def __init__(self, words: list[str] = ()):
        ranked = dict.fromkeys([*COMMON, *words])
        self.rank = {w: k + 1 for k, w in enumerate(ranked) if len(w) > 1}
        self.longest = min(MAX_WORD, max(map(len, self.rank)))
        self.pairs = Counter({pair: 300 // (k + 10) + 1 for k, pair in enumerate(PAIRS)})
        for w in self.rank:
            self.pairs.update(map("".join, zip(w, w[1:])))
        self.after = Counter()
        for pair, n in self.pairs.items():
            self.after[pair[0]] += n

    def word_bits(self, piece: str) -> float | None:
        rank = self.rank.get(piece.lower())
        if rank is None:
            return None
        upper = sum(map(str.isupper, piece))
        shape = 0 if not upper else 1 if upper == len(piece) or piece[0].isupper() and upper == 1 else upper + 1
        return math.log2(rank + 1) + shape

    def unknown_word_bits(self, piece: str) -> float:
        """Of a word that the dictionary lacks: its letter pairs are as in the
        dictionary's words, so that spelling it costs less than brute force."""
        low = piece.lower()
        spelled = brute = _char_bits(low[0])
        for a, b in zip(low, low[1:]):
            each = _char_bits(b)
            brute += each
            spelled -= math.log2((self.pairs[a + b] + 4 * 2.0 ** -each) / (self.after[a] + 4))
        return min(spelled, UNKNOWN_BITS) + (piece != low) if spelled < brute else math.inf

    def secret(self, value: str, min_bits: float = MIN_BITS) -> bool:
        """Whether a value costs ``min_bits`` or, if it is too short for that,
        about what brute force does; words that the dictionary lacks are no
        brute force."""
        brute = sum(map(_char_bits, value)) + SEGMENT_BITS
        cost = self.bits(value)
        return cost >= min_bits or min(cost, self.bits(value, unknown=True)) >= NEAR_BRUTE * brute

    def bits(self, value: str, unknown: bool = False) -> float:
        """Linear in the value but for the word length: runs are found once,
        and any part of a run may be a segment that ends with it. With
        ``unknown``, words that the dictionary lacks are segments, too."""
        n = len(value)
        low = value.lower()
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            for j in range(i + 2, min(n, i + self.longest) + 1):
                cost = self.word_bits(value[i:j])
                if cost is not None:
                    ends[j].append((i, cost))
            if (m := DATE.match(value, i)) is not None:
                ends[m.end()].append((i, DATE_BITS))
            if (m := YEAR.match(value, i)) is not None:
                ends[m.end()].append((i, YEAR_BITS))
        self._runs(low, ends)
        for i, j in _letter_runs(value) if unknown else ():
            ends[j].append((i, self.unknown_word_bits(value[i:j])))
        best = [0.0] + [math.inf] * n
        brute = [0.0]
        for ch in value:
            brute.append(brute[-1] + _char_bits(ch))
        cheapest = 0.0  # of opening a brute-force span at any earlier place
        for j in range(1, n + 1):
            best[j] = cheapest + brute[j] + SEGMENT_BITS
            for i, cost in ends[j]:
                best[j] = min(best[j], best[i] + cost + SEGMENT_BITS)
            cheapest = min(cheapest, best[j] - brute[j])
        return best[n]

    def _runs(self, low: str, ends: list[list[tuple[int, float]]]) -> None:
        n = len(low)

        def close(i: int, j: int, first: float, each: float) -> None:
            for a in range(i, j - 2):  # a run's tails; its heads end inside and are added as they go
                if a == i or j - a <= MAX_WORD:
                    ends[j].append((a, first + math.log2(j - a) + each * (j - a - 1)))

        def repeat(i: int, j: int, period: int) -> None:
            block = sum(map(_char_bits, low[i:i + period]))
            ends[j].append((i, block + math.log2((j - i) / period)))
            whole = i + (j - i) // period * period
            if whole != j:
                ends[whole].append((i, block + math.log2((whole - i) / period)))

        for period in range(1, SHORT_PERIOD + 1):
            i = 0
            while i + period < n:
                j = i + period
                while j < n and low[j] == low[j - period]:
                    j += 1
                if j - i >= max(3, 2 * period):
                    repeat(i, j, period)
                i = max(i + 1, j - period + 1)
        # longer periods: where a piece longer than the short ones comes again
        seen: dict[str, int] = {}
        i = 0
        while i + SHORT_PERIOD < n:
            piece = low[i:i + SHORT_PERIOD + 1]
            before = seen.get(piece)
            seen[piece] = i
            period = i - before if before is not None else 0
            if period > SHORT_PERIOD:
                j = i + SHORT_PERIOD + 1
                while j < n and low[j] == low[j - period]:
                    j += 1
                if j - before >= 2 * period:
                    repeat(before, j, period)
                    i = j - SHORT_PERIOD - 1
            i += 1
        i = 0
        while i + 1 < n:  # abc, 321
            step, j = ord(low[i + 1]) - ord(low[i]), i + 1
            if abs(step) == 1:
                while j < n and ord(low[j]) - ord(low[j - 1]) == step:
                    j += 1
                if j - i >= 3:
                    close(i, j, math.log2(36) + 1, 0.0)
            i = max(i + 1, j - 1)
        i = 0
        while i < n:  # qwerty, asdf
            j = i + 1
            turns, last = 0, None
            while j < n and low[j] in NEAR.get(low[j - 1], ()):
                way = next((r.index(low[j]) - r.index(low[j - 1]) for r in ROWS if low[j] in r and low[j - 1] in r), 9)
                turns, last = turns + (way != last), way
                j += 1
            if j - i >= 3:
                ends[j].append((i, math.log2(47) + math.log2(j - i) + turns * 3.0))
            i = max(i + 1, j)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and not overlapping
    within a kind, by start and then by the order of the kinds."""
    spans = []
    low = text.lower()
    if any(s in low for s in ASSIGN_STEMS):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], BASE_KINDS.index(s[2])))


def guessed_spans(text: str, base: list[tuple[int, int, str]], model: GuessCost,
                  min_bits: float = MIN_BITS) -> list[tuple[int, int, str]]:
    """Values in a credential's context, as kind ``guess``, that are secrets by
    their guess cost or because a base span covers a part of them; not those
    that a base span covers as a whole."""
    low = text.lower()
    if not any(s in low for s in CONTEXT_STEMS):
        return []
    found = []
    for m in CONTEXT.finditer(text):
        group = m.lastindex
        start, end = m.span(group)
        value = text[start:end]
        if group not in QUOTED:
            if (other := NEXT_NAME.search(value)) is not None:
                value = value[:other.start()]
            value = value.rstrip(".,;:!?)]}'\"")
        end = start + len(value)
        if len(value) < 6 and group != SHORT_PIN or any(a <= start and end <= b for a, b, _ in base):
            continue
        if any(a < end and start < b for a, b, _ in base) or model.secret(value, min_bits):
            found.append((start, end, "guess"))
    return found


def _digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _scan(batches: Iterator[pa.RecordBatch], words: list[str], min_bits: float) -> Iterator[pa.RecordBatch]:
    model = GuessCost(words)
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            base = base_spans(text)
            every = sorted(base + guessed_spans(text, base, model, min_bits),
                           key=lambda s: (s[0], (*BASE_KINDS, "guess").index(s[2])))
            kinds = [k for _, _, k in base]
            rows.append((*(kinds.count(k) for k in BASE_KINDS),
                         hashlib.sha256(_digest(base).encode()).hexdigest(), _digest(every)))
        if rows:
            columns = [batch.column("doc_id"), *(pa.array(c) for c in zip(*rows))]
            yield pa.RecordBatch.from_arrays(
                columns, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


#: What a value looks like to the dictionary's word count (Java syntax).
VALUE = r"""(?:[:=]>?|(?i:bearer))["']?[ \t]+\S+"""


def frequent_words(docs: DataFrame, text_col: str = "text", n: int = DICTIONARY_WORDS) -> list[str]:
    """The ``n`` most frequent words of letters of all documents, most frequent first, then by code point;
    they are the dictionary of the guess cost. Counted over the whole corpus, combined before the shuffle. What
    follows a colon, an equals sign or "bearer" is not counted, so that no value is in its own dictionary."""
    word = F.lower(F.regexp_replace("word", r"^[^\p{L}]+|[^\p{L}]+$", ""))
    counts = (docs.select(F.explode(F.split(F.regexp_replace(col(text_col), VALUE, " "), BLANK)).alias("word")).groupBy("word")
              .agg(F.count(F.lit(1)).alias("n")).select(word.alias("word"), "n")
              .where((F.length("word") > 1) & (F.length("word") <= MAX_WORD) & ~F.col("word").rlike(r"[^\p{L}]"))
              .groupBy("word").agg(F.sum("n").alias("n")))
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(n).collect()]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bits: float = MIN_BITS,
                 dictionary_words: int = DICTIONARY_WORDS) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` per document.

    Base spans are whole matches of the three patterns in code points;
    ``spans`` adds kind ``guess``: values in a credential's context whose guess
    cost is ``min_bits`` or more or near that of brute force, and whole values
    of which a base span holds only a part. The cost's dictionary is the
    corpus's own ``dictionary_words`` most frequent words behind a fixed list
    of common passwords, so prose after a colon is cheap and random text is not.

    A null or empty text has no spans; rows are independent, so repeated rows
    get equal results and ids may be null. An empty table gives no rows.
    Other columns are not read. Nothing is shuffled but word counts.
    """
    python_ready(docs.sparkSession)
    words = frequent_words(docs, text_col, dictionary_words)
    source = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(
        lambda it: _scan(it, words, min_bits),
        f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
