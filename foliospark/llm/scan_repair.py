"""Repairing text from scanned pages.

1. Words are counted over all blocks, and skip-gram vectors learnt from them by factorizing their
   shifted pointwise information (what training with negative samples does implicitly). The *core*
   are the words of at least one in ``share`` tokens, so it is bounded; the most frequent of them
   have vectors.
2. A rare word is linked to the words far more frequent than it that plausible glyph edits lead to,
   if these are near it in the space of the vectors: its own vector is the sum of its contexts'. The
   links of core words are looked up in the core. Whatever else the texts hold is asked of the whole
   table of words, by a join on the strokes that look-alikes have in common, so no word is too rare
   to be linked to or to have its own count respected. What fits its neighbours' vectors corrects.
3. Running headers, footers and page numbers are found at the edges of blocks, by recurring within
   their document or by breaking off a line that had room for the next word.
4. What is left is reflowed: words broken at line and page ends are joined, lines become paragraphs,
   and a paragraph goes on over the page when its sentence does.

All thresholds are ratios of counts or shares of all tokens, so a corpus ten times as large of the
same texts is repaired in the same way.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.workspace import materialize

# What scanners read for what was printed.
LOOKALIKES = (
    ("c", "e"), ("@", "a"), ("+", "t"), ("!", "i"), ("5", "s"), ("0", "o"), ("ri", "n"), ("I", "l"), ("cl", "d"), ("1", "l"), ("1", "i"), ("ii", "u"),
    ("b", "h"), ("m", "in"), ("9", "g"), ("rn", "m"), ("6", "b"), ("h", "li"), ("vv", "w"), ("d", "cl"), ("m", "rn"), ("8", "b"), ("3", "e"), ("4", "a"),
    ("7", "t"), ("|", "l"), ("|", "i"), ("$", "s"),
)
#: What look-alikes are made of: each edit above leaves the strokes of a word as they are.
STROKES = {
    "@": "a", "4": "a", "+": "t", "7": "t", "!": "l", "1": "l", "|": "l", "i": "l", "r": "l", "3": "c", "e": "c", "5": "s", "$": "s", "0": "o", "9": "g",
    "n": "ll", "u": "ll", "h": "ll", "b": "ll", "6": "ll", "8": "ll", "m": "lll", "w": "vv", "d": "cl",
}
#: Marks that break a word at the end of a line.
BREAKS = "-¬­‐"
_BREAKS = frozenset(BREAKS)
_SECOND = re.compile(r"\s*([^\W\d_][\w@+!|$]*(?:-[^\W\d_]+)*)")
_TAIL = re.compile(r"\S*")
_BROKEN = re.compile(rf"([^\W\d_][\w@+!|$]*)([{BREAKS}])[ \t]*$")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_PIECE = re.compile(r"[\w@+!|$]+(?:[-'’][\w@+!|$]+)*")
_LISTED = re.compile(r"^\s*(?:[-*+•◦▪‣☐☑✓–—]|\(?\d{1,3}[.)]|\(?[A-Za-z][.)])\s+\S|\.{4}|\|.*\||\t|;.*;.*;|\S {3,}\S.* {3,}|\(\d+\)\s*$")
_MARKS = re.compile(r"[|\t;]|\.{4}| {3}|\)\s*$", re.M)
_STARTS = re.compile(r"\s*[^\w\s]|\s*\w{1,3}[.)]")
_NUMBER = r"(?:[\dlIOoSB|]{0,3}\d[\dlIOoSB|]{0,3}|[lI1][lI1oO\d]{1,3}|[ivxlcIVXLC]{1,8}|1[ivxlc]{1,6})"
_PAGE = re.compile(rf"^[\W_]*(?:p(?:age|agc|@ge|a9e|g)?\.?\s*)?{_NUMBER}(?:\s*(?:of|0f|/)\s*[\dlIOo]+)?[\s\-–—\])|]*$", re.I)
_LEADING = re.compile(rf"^\s*{_NUMBER}(?:\s{{2,}}|\t|\s*[|·–—]\s*)(?=\S)")
_TRAILING = re.compile(rf"(?<=\S)(?:\s{{2,}}|\t|\s*[|·–—]\s*)(?:p(?:age)?\.?\s*)?{_NUMBER}\s*$", re.I)


def glyph_edits(piece: str, own: int, counts: Mapping[str, int], ratio: float) -> list[str]:
    """The words of ``counts`` that one plausible glyph edit of ``piece``, or else two, lead to and that
    are ``ratio`` times as frequent as it; the most frequent first."""
    lower = piece.lower()
    if not 2 <= len(piece) <= 40 or not piece.isascii() or not any(c.isalpha() for c in piece):
        return []
    if len(piece) == 2 and piece.isalpha() and piece[1] != "I":
        return []
    if sum(c.isdigit() for c in piece) * 2 > len(piece) and len(piece) > 2:
        return []
    least = max(1, own) * ratio
    out: set[str] = set()
    first = {piece}
    for _ in range(2):
        after = set()
        for form in first:
            for wrong, right in LOOKALIKES:
                at = form.find(wrong)
                while at >= 0:
                    after.add(form[:at] + right + form[at + len(wrong) :])
                    at = form.find(wrong, at + 1)
        # the same letters in another order are a typing error
        out = {w for w in (a.lower() for a in after) if counts.get(w, 0) >= least and len(w) > 1 + piece.isalpha() and sorted(w) != sorted(lower)}
        if out or len(piece) < 4:
            break
        first = after
    return sorted(out, key=lambda w: (-counts.get(w, 0), w))


@dataclass
class Lexicon:
    """The core words with their counts, vectors, and the words known to be right.

    ``words(word, n)`` is the table of all words; without it the core is all there is. ``found`` has
    what that table says of other strings of the text at hand: counts and links.
    """

    counts: dict[str, int] = field(default_factory=dict)
    index: dict[str, int] = field(default_factory=dict)
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.float32))
    contexts: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.float32))
    sure: frozenset[str] = frozenset()
    ratio: float = 30.0
    #: how often each context word is met, the first words of ``index``
    met: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: shapes of lines that stand at the edges of blocks and not within
    shapes: frozenset[str] = frozenset()
    #: a bit for each known word outside of the core, by its CRC
    filter: bytes = b""
    least: float = 1
    apart: float = 0.1
    words: DataFrame | None = None

    def __post_init__(self) -> None:
        self.found: dict[str, tuple[int, list[str]]] = {}
        self._links: dict[str, list[str]] = {}
        self._inverse: np.ndarray | None = None
        self.tokens: dict[str, _Token] = {}
        self.plain: set[str] = set()
        self.leads = {w[:k] for w in self.counts for k, c in enumerate(w) if c == "-"}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"words": None}  # tables stay with the driver

    def count(self, word: str) -> int:
        n = self.counts.get(word)
        return n if n is not None else self.found.get(word, (0,))[0]

    def may_know(self, word: str) -> bool:
        """Whether the table of all words may hold ``word``, which isn't of the core, as a known one."""
        if word in self.counts or not self.filter:
            return False
        at = zlib.crc32(word.encode()) % (8 * len(self.filter))
        return bool(self.filter[at >> 3] & 1 << (at & 7))

    def known(self, word: str) -> bool:
        return word in self.sure or self.count(word) >= self.least

    def links(self, piece: str) -> list[str]:
        """Frequent words that glyph edits of ``piece`` lead to; none if it is right as it is."""
        if piece in self.found:
            return self.found[piece][1]
        links = self._links.get(piece)
        if links is None:
            if len(self._links) > 500_000:
                self._links.clear()
            links = self._links[piece] = self._edit(piece)
        return links

    def _edit(self, piece: str) -> list[str]:
        if piece == "@":
            return ["a"]
        lower = piece.lower()
        if lower in self.sure:
            return []
        n = self.count(lower)
        out = glyph_edits(piece, n, self.counts, self.ratio)
        if out and lower in self.index and len(self.vectors):
            vector = self.vectors[self.index[lower]]
            out = [w for w in out if self.near(vector, n, w, self.counts[w])]
        return out

    def fold_in(self, at: np.ndarray, n: np.ndarray, negatives: int = 5) -> np.ndarray:
        """The vector of a word that meets the context words ``at`` ``n`` times each."""
        among = self.contexts[: len(self.met)]
        shifted = np.maximum(np.log(n / n.sum() * self.met.sum() / np.maximum(self.met[at], 1)) - np.log(negatives), 0)
        if self._inverse is None:
            self._inverse = np.linalg.pinv(among.T @ among)
        return (shifted @ among[at]) @ self._inverse

    def near(self, vector: np.ndarray, n: int, word: str, word_n: int, told: np.ndarray | None = None) -> bool:
        """Whether a word of that ``vector``, met ``n`` times, is near enough to ``word`` to be it misread.

        The more frequent ``word`` is beside it, the likelier is a misreading, and the less need the
        contexts say for it: by ``apart`` of cosine for each power of ten, up to a thousand. Where the
        contexts tell nothing, nothing speaks against it.
        """
        if word in self.index and len(self.vectors):
            told = self.vectors[self.index[word]]
        length = float(np.linalg.norm(vector) * np.linalg.norm(told)) if told is not None else 0.0
        if not length:
            return True
        return float(vector @ told) / length >= -self.apart * min(3.0, np.log10(word_n / max(1, n)))

    def best(self, links: list[str], around: list[str]) -> str:
        """Of several links the one whose vector fits the neighbours' best."""
        if len(links) == 1:
            return links[0]
        near = [i for i in (self.index.get(w) for w in around) if i is not None]
        if not near:
            return links[0]
        context = self.contexts[near].sum(axis=0)
        score = [float(self.vectors[self.index[w]] @ context) if w in self.index else 0.0 for w in links]
        return links[int(np.argmax(score))]


def _broken_ends(text: str) -> Iterator[tuple[str, str]]:
    """The tokens around each line end of ``text`` that a break mark stands at."""
    lines = text.split("\n")
    for line, after in zip(lines, lines[1:]):
        if line.rstrip(" \t")[-1:] in _BREAKS and after.strip():
            yield line.split()[-1], after.split(maxsplit=1)[0]


def shape(line: str) -> str | None:
    """The form of a line that may be a mark or code: letters as ``A``, digits as ``9``. None for lines of
    words: it has a digit, at most two tokens, and no run of five letters."""
    x = line.strip()
    if len(x) > 24 or len(x.split()) > 2 or not re.search(r"\d", x) or re.search(r"[^\W\d_]{5}", x):
        return None
    return re.sub(r"\d+", "9", re.sub(r"[^\W\d_]+", "A", x))


def _count(blocks: DataFrame) -> DataFrame:
    """``(kind, word, n)`` over all texts: of kind ``word`` the words, without those broken at line ends;
    of kind ``edge`` and ``inner`` the shapes of lines at the edges of blocks and within."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def done() -> pa.RecordBatch:
            kinds, words = zip(*counts) if counts else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())], names=["kind", "word", "n"])

        for batch in batches:
            tokens: Counter = Counter()  # words are looked for once in each different token
            for text in batch.column("text").to_pylist():
                if text:
                    tokens.update(text.split())
                    if "\n" in text:
                        for halves in _broken_ends(text):
                            tokens.subtract(halves)
                        lines = _lines(text)
                        for k, x in enumerate(lines):
                            if len(x) <= 30 and (form := shape(x)):
                                counts["edge" if k < 2 or k >= len(lines) - 3 else "inner", form] += 1
            for token, n in tokens.items():
                if n > 0:
                    for word in _WORD.findall(token.lower()):
                        counts["word", word] += n
            if len(counts) > 400_000:
                yield done()
                counts.clear()
        yield done()

    return blocks.select("text").mapInArrow(run, "kind string, word string, n bigint").groupBy("kind", "word").agg(F.sum("n").alias("n"))


def _edge_shapes(counted: DataFrame, least: int, share: int) -> frozenset[str]:
    """The shapes met at edges ``least`` times, at least once in ``share`` lines of such shapes, and 30
    times as often as within blocks: at most ``share``."""
    by = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0))
    forms = counted.filter("kind <> 'word'").groupBy("word").agg(by("edge").alias("edge"), by("inner").alias("inner")).filter(F.col("edge") >= least)
    total = forms.agg(F.sum("edge")).first()[0] or 0
    return frozenset(r["word"] for r in forms.filter((F.col("edge") >= 30 * F.col("inner")) & (F.col("edge") >= total / share)).collect())


def _skip_grams(blocks: DataFrame, index: dict[str, int], contexts: int, window: int) -> DataFrame:
    """``(pair, n)``: how often word ``pair // contexts`` has context word ``pair % contexts`` near."""
    size = len(index) * contexts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            ids: list[int] = []
            known: dict[str, list[int]] = {}
            for text in batch.column("text").to_pylist():
                if text:
                    for token in text.split():
                        if token not in known:
                            known[token] = [index.get(w, -1) for w in _WORD.findall(token.lower())]
                        ids += known[token]
                    ids += [-1] * window
            a = np.array(ids, np.int64)
            for step in range(1, window + 1):
                left, right = a[:-step], a[step:]
                both = (left >= 0) & (right >= 0)
                for x, y in ((left, right), (right, left)):
                    at = both & (y < contexts)
                    total += np.bincount(x[at] * contexts + y[at], minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["pair", "n"])

    return blocks.select("text").mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def learn(blocks: DataFrame, sure: frozenset[str] = frozenset(), least: int = 8, share: int = 400_000, known_share: int = 3_000_000, words: int = 4096, contexts: int = 256, window: int = 2, size: int = 48, negatives: int = 5) -> Lexicon:
    """The lexicon of ``blocks(text)``.

    The core, words of at least ``least`` occurrences and one in ``share`` tokens, comes to the driver:
    at most ``share`` words. The ``words`` most frequent of them have vectors of ``size`` numbers, from
    counts with the ``contexts`` most frequent. All other words stay in a table of the shared folder;
    they are as good as those of the core, which is only there to look most words up without a join.
    Words of at least ``least`` occurrences and one in ``known_share`` tokens are known ones.
    """
    every = materialize(_count(blocks), "scan-words")
    counted = every.filter("kind = 'word'").select("word", "n")
    total = counted.agg(F.sum("n")).first()[0] or 0
    rows = counted.filter(F.col("n") >= max(least, total / share)).toArrow()
    core = sorted(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist()), key=lambda r: (-r[1], r[0]))
    lexicon = Lexicon(dict(core), {w: k for k, (w, _) in enumerate(core[:words])}, sure=sure, words=counted, shapes=_edge_shapes(every, least, share))
    lexicon.least = max(least, total / known_share)
    known = counted.filter((F.col("n") >= lexicon.least) & (F.col("n") < max(least, total / share))).select(F.crc32(F.encode("word", "utf-8")).alias("crc"))
    codes = known.toArrow().column("crc").to_numpy()  # at most known_share numbers
    bits = np.zeros(max(64, 1 << (32 * len(codes)).bit_length()), np.uint8)
    bits[codes % len(bits)] = 1
    lexicon.filter = np.packbits(bits, bitorder="little").tobytes()
    contexts = min(contexts, len(lexicon.index))
    if not contexts:
        return lexicon
    pairs = _skip_grams(blocks, lexicon.index, contexts, window).toArrow()  # at most words x contexts
    n = np.zeros((len(lexicon.index), contexts))
    at = pairs.column("pair").to_numpy()
    n[at // contexts, at % contexts] = pairs.column("n").to_numpy()
    with np.errstate(divide="ignore", invalid="ignore"):
        shifted = np.log(n * n.sum() / np.maximum(n.sum(1, keepdims=True) * n.sum(0, keepdims=True), 1)) - np.log(negatives)
    shifted = np.where(n > 0, np.maximum(shifted, 0), 0)
    u, s, v = np.linalg.svd(shifted, full_matrices=False)
    size = min(size, len(s))
    lexicon.vectors = (u[:, :size] * np.sqrt(s[:size])).astype(np.float32)
    around = np.zeros_like(lexicon.vectors)
    around[:contexts] = v[:size].T * np.sqrt(s[:size])
    lexicon.contexts = around
    lexicon.met = n.sum(0)
    return lexicon


def strokes(word: Column) -> Column:
    """The strokes of a word, the same for all its look-alikes."""
    one = {k: v for k, v in STROKES.items() if len(v) == 1}
    out = F.translate(F.lower(word), "".join(one), "".join(one.values()))
    for glyph, of in STROKES.items():
        if len(of) > 1:
            out = F.replace(out, F.lit(glyph), F.lit(of))
    return out


def _asked(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``(doc_id, sec_idx, block_order, piece, near)``: what the core can't tell of ``rows`` and their
    repair may look up: other words and word-like pieces, the wholes of broken words, and odd words put
    together with their neighbours. ``near`` are the context words around it."""
    contexts = len(lexicon.met)
    schema = pa.schema([("doc_id", pa.string()), ("sec_idx", pa.int32()), ("block_order", pa.int32()), ("piece", pa.string()), ("near", pa.list_(pa.int32()))])

    def unknown(part: str) -> bool:
        lower = part.lower()
        if lower in lexicon.counts:
            return lower not in lexicon.index and bool(lexicon.links(part))
        return len(part) <= 40 and any(c.isalpha() for c in part)

    def parts(w: str) -> tuple[list[str], bool]:
        """The unknown parts of a token, and whether it is odd to the core."""
        if re.search(r"[_/\\]|\.\w", w):
            return [], False
        found = [p for m in _PIECE.finditer(w) for p in re.findall(r"[^-'’]+", m.group()) if unknown(p)]
        return found, bool(found) or _token(w, lexicon) is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain: set[str] = set()
        odd: dict[str, list[str]] = {}
        for batch in batches:
            if len(plain) + len(odd) > 500_000:
                plain.clear()
                odd.clear()
            out: list[list] = [[], [], [], [], []]

            def ask(at: tuple, piece: str, near: list[int] = []) -> None:
                for column, value in zip(out, (*at, piece, near)):
                    column.append(value)

            for *at, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "sec_idx", "block_order", "text"))):
                if not text:
                    continue
                words = text.split()
                for k in [k for k, w in enumerate(words) if w not in plain]:
                    w = words[k]
                    if w not in odd:
                        found, is_odd = parts(w)
                        if not is_odd:
                            plain.add(w)
                            continue
                        odd[w] = found
                    if odd[w]:
                        near = [i for x in (*words[max(0, k - 2) : k], *words[k + 1 : k + 3]) if (i := lexicon.index.get(_word(x), contexts)) < contexts]
                        for part in odd[w]:
                            ask(at, part, near)
                    for left in (k - 1, k):
                        if 0 <= left < len(words) - 1 and words[left].isalpha():
                            whole = words[left].lower() + _word(words[left + 1])
                            if lexicon.may_know(whole):
                                ask(at, whole)
                if "\n" in text:
                    for first, second in _broken_ends(text):
                        first, second = _BROKEN.search(first), _SECOND.match(second)
                        if first and second:
                            first, second = first[1], second[1]
                            for piece in (first + second, f"{first}-{second}", first + second.split("-")[0]):
                                if lexicon.may_know(piece.lower()):
                                    ask(at, piece.lower())
                            for piece in (first, second, first + second):
                                if unknown(piece):
                                    ask(at, piece)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)

    return rows.select("doc_id", "sec_idx", "block_order", "text").mapInArrow(run, "doc_id string, sec_idx int, block_order int, piece string, near array<int>")


def _answers(asked: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``(piece, n, links)``: what the table of all words says of each different piece asked for.

    Candidates for its links share its strokes and are frequent enough; those that glyph edits really
    lead to, and that are near it by the vectors, are kept.
    """
    words = lexicon.words
    each = asked.repartition("piece").select("piece", F.explode_outer("near").alias("at")).groupBy("piece", "at").agg(F.count(F.lit(1)).alias("n"))
    met = F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "n")))  # at most as many as there are contexts
    of = each.groupBy("piece").agg(met.alias("near")).select("piece", F.when(F.size("near") > 0, F.col("near")).alias("near"), F.lower("piece").alias("word"))
    of = of.join(words, "word", "left").withColumns({"n": F.coalesce("n", F.lit(0).cast("bigint")), "strokes": strokes(F.col("piece"))})
    of = materialize(of, "scan-asked")
    targets = words.filter(F.col("n") >= lexicon.ratio).select(F.col("word").alias("target"), F.col("n").alias("target_n"), strokes(F.col("word")).alias("strokes"))
    own = of.filter("near is not null").select(F.col("piece").alias("target"), F.col("near").alias("target_near"))
    met = of.join(targets, "strokes").filter(F.col("target_n") >= lexicon.ratio * F.greatest(F.col("n"), F.lit(1))).filter("target != word").join(own, "target", "left")
    candidates = met.groupBy("piece", "n").agg(F.any_value("near").alias("near"), F.collect_list(F.struct("target", "target_n", "target_near")).alias("targets"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def context(near: list[dict] | None) -> tuple[np.ndarray, np.ndarray] | None:
            return (np.array([x["at"] for x in near]), np.array([x["n"] for x in near], float)) if near else None

        for batch in batches:
            pieces, links = [], []
            for r in batch.to_pylist():
                counted = {t["target"]: t["target_n"] for t in r["targets"]}
                found = [] if r["piece"].lower() in lexicon.sure else glyph_edits(r["piece"], r["n"], counted, lexicon.ratio)
                around = context(r["near"])
                if found and around:
                    vector = lexicon.fold_in(*around)
                    told = {t["target"]: lexicon.fold_in(*c) for t in r["targets"] if t["target"] not in lexicon.index and (c := context(t["target_near"]))}
                    found = [w for w in found if lexicon.near(vector, r["n"], w, counted[w], told.get(w))]
                pieces.append(r["piece"])
                links.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.string()), pa.array(links, pa.list_(pa.string()))], names=["piece", "links"])

    linked = candidates.mapInArrow(run, "piece string, links array<string>")
    return of.select("piece", "n").join(linked, "piece", "left").filter((F.col("n") >= lexicon.least) | F.col("links").isNotNull()).withColumn("links", F.coalesce("links", F.array().cast("array<string>")))


class _Letters(dict):
    """For ``str.translate``: letters and what looks like them as their strokes, all else left out."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        self[code] = out = STROKES.get(c) or (c if c.isalpha() else None)
        return out


_LETTERS = _Letters()
_SET_OFF = re.compile(r"\s\s|[\t|·–—]")


def _plain(line: str) -> str:
    """A line as its recurrences share it: without numbers, case, spaces and common misreadings."""
    if _SET_OFF.search(line):
        line = _TRAILING.sub("", _LEADING.sub("", line))
    return line.lower().translate(_LETTERS)


def _sentence_end(line: str) -> bool:
    return bool(re.search(r"[.!?…][)\]\"'”’»]*(?:\s*\[[^\]]*\])?$", line.rstrip()))


@dataclass
class Block:
    block_id: str
    page: int | None
    lines: list[str]
    head: list[str] = field(default_factory=list)
    foot: list[str] = field(default_factory=list)
    noise: set[str] = field(default_factory=set)
    words: list[str] = field(default_factory=list)


def _listed(lines: list[str]) -> bool:
    """Whether more than a third of the lines are of a list, a table or contents."""
    marked = bool(_MARKS.search("\n".join(lines)))
    return sum(bool(_LISTED.search(x)) for x in lines if marked or _STARTS.match(x)) * 3 > len(lines)


def _page(line: str, page: int | None) -> bool:
    """A line that is a page number; one of four digits only if it is the page's own."""
    return bool(_PAGE.match(line)) and (not re.search(r"\d{4}", line) or re.sub(r"\D", "", line) == str(page))


def _wraps(line: str, following: str, width: int) -> bool:
    """Whether ``line`` had no room left for the first word of ``following``."""
    word = following.split(maxsplit=1)[0] if following.strip() else ""
    return len(line.rstrip()) + 1 + len(word) > width


def _edges(lines: list[str]) -> Iterator[tuple[str, str]]:
    """Lines at a block's edges as their recurrences share them, each with the line inside of it."""
    for x, inner in [*zip(lines[:2], lines[1:3]), *zip(lines[-2:], lines[-3:-1])]:
        if len(x) <= 90 and len(p := _plain(x)) >= 5:
            yield p, inner


def _furniture(blocks: list[Block], recurring: set[str] | None = None, shapes: frozenset[str] = frozenset()) -> None:
    """Move header, footer and number lines out of the blocks, which are in reading order.

    ``recurring`` are the edge lines of the whole document that recur; without it ``blocks`` are all.
    ``shapes`` are those of lines that the corpus has at edges only.
    """
    if recurring is None:
        beside: dict[str, set[str]] = defaultdict(set)  # what stands inside of a line where it recurs
        for b in blocks:
            for p, inner in _edges(b.lines):
                beside[p].add(inner)
        recurring = {p for p, inner in beside.items() if len(inner) > 1}
    widths = sorted(len(x.rstrip()) for b in blocks for x in b.lines[1:-1])
    filled = [_wraps(x, y, max(map(len, b.lines[1:-1]))) for b in blocks if len(b.lines) > 4 for x, y in zip(b.lines[1:-2], b.lines[2:-1])]
    even = sum(filled) >= 0.9 * len(filled)
    for b in blocks:
        if len(b.lines) < 2 or _listed(b.lines):
            continue  # nothing at the edges; a list, a table or contents
        inner = [len(x.rstrip()) for x in b.lines[1:-1]]
        width = max(inner) if len(inner) >= 3 else (widths[-1] if len(widths) >= 6 else 0)

        def odd(line: str) -> bool:
            return len(line) <= 90 and not _sentence_end(line) and line.rstrip()[-1:] not in (*BREAKS, ",", ";", ":")

        for _ in range(2):  # the top: a number line, a header line
            if len(b.lines) < 2:
                break
            x = b.lines[0]
            number = _page(x, b.page)
            recurs = _plain(x) in recurring and odd(x)
            titled = bool(_LEADING.search(x) or _TRAILING.search(x))
            short = even and width >= 30 and odd(x) and not _wraps(x, b.lines[1], width) and x[:1].isalnum() and len(b.lines) > 2 and not b.head
            starts = b.lines[1].lstrip()[:1]
            if number or (recurs and len(x) < 90) or (titled and odd(x) and len(x) < 80) or (short and (x[:1].isupper() or x[:1].isdigit()) and (starts.isupper() or not x.rstrip()[-1:].islower())):
                b.head.append(b.lines.pop(0))
            else:
                break
        for _ in range(3):  # the bottom: number and footer lines
            if len(b.lines) < 2:
                break
            x, before = b.lines[-1], b.lines[-2]
            number = _page(x, b.page)
            recurs = _plain(x) in recurring and odd(x)
            after_end = even and odd(x) and len(x) < 60 and x[:1].isupper() and _sentence_end(before) and len(x.split()) <= 7 and width >= 30 and len(x) < width * 0.75 and (not _wraps(before, x, width))
            if number or recurs or (odd(x) and shape(x) in shapes) or after_end:
                b.foot.insert(0, b.lines.pop())
            else:
                break


def _numbered(line: str) -> bool:
    return bool(_PAGE.match(line) or _LEADING.search(line) or _TRAILING.search(line))


def _joined(first: str, mark: str, second: str, lexicon: Lexicon) -> tuple[str, bool]:
    """The word of two halves, and whether the mark was no part of it."""
    whole, hyphened = (first + second).lower(), f"{first}-{second}".lower()
    one, two = lexicon.count(whole), lexicon.count(hyphened)
    if mark in "¬­":
        return first + second, True
    if one or two:
        return (first + second, True) if one >= two else (f"{first}-{second}", False)
    if lexicon.links(first + second):
        return first + second, True
    if second[:1].isupper() and first[-1:].islower():  # the other half is lost
        return f"{first}{mark} {second}", True
    if "-" in second and lexicon.known((first + second.split("-")[0]).lower()):
        return first + second, True
    real = lexicon.known(second.lower()) or bool(lexicon.links(second))
    lead = lexicon.known(first.lower()) or first.lower() in lexicon.leads
    return (f"{first}-{second}", False) if real and lead and len(first) > 1 else (first + second, True)


def _read(blocks: list[Block], lexicon: Lexicon, ahead: str = "") -> None:
    """Noise and repaired words of each block; a word broken over blocks goes to the first.

    ``ahead`` is what the text goes on with behind the last block.
    """
    for k, b in enumerate(blocks):
        if any(_numbered(x) for x in (*b.head, *b.foot)):
            b.noise.add("pageno")
        if any(not _PAGE.match(x) for x in (*b.head, *b.foot)):
            b.noise.add("header")
        lines = b.lines
        for i, line in enumerate(lines):
            broken = _BROKEN.search(line) if line.rstrip(" \t")[-1:] in _BREAKS else None
            if not broken:
                b.words += line.split()
                continue
            after, where = (lines[i + 1], None) if i + 1 < len(lines) else ("", None)
            if not after:
                where = next((x for x in blocks[k + 1 :] if x.lines), None)
                after = where.lines[0] if where else ahead
            second = _SECOND.match(after)
            if not second:
                if broken[2] != "-" or (not after and not lexicon.known(broken[1].lower())):
                    b.noise.add("hyphen")
                b.words += line.split()
                continue
            word, noise = _joined(broken[1], broken[2], second[1], lexicon)
            if noise:
                b.noise.add("hyphen")
            tail = _TAIL.match(after, second.end())[0]
            b.words += [*line[: broken.start()].split(), word + tail]
            rest = after[second.end() + len(tail) :]
            if where:
                where.lines[0] = rest
            elif i + 1 < len(lines):
                lines[i + 1] = rest


@dataclass(frozen=True)
class _Token:
    """The links of a token's parts by where they stand."""

    links: tuple[tuple[int, int, list[str]], ...]


def _token(w: str, lexicon: Lexicon) -> _Token | None:
    """None for a token that needs no second look: words of the core, and what isn't words."""
    if re.search(r"[_/\\]|\.\w", w):
        return None
    pieces = list(_PIECE.finditer(w))
    links = []
    for m in pieces:
        for part in re.finditer(r"[^-'’]+", m.group()):
            if found := lexicon.links(part.group()):
                links.append((m.start() + part.start(), m.start() + part.end(), found))
    single = pieces[0].group().lower() if len(pieces) == 1 and pieces[0].group().isalpha() else None
    plain = single is None or single in lexicon.counts or single in lexicon.sure
    return None if plain and not links else _Token(tuple(links))


def _word(w: str) -> str:
    return w.strip(".,;:!?()[]\"'“”‘’").lower()


def _two_parts(left: str, right: str, lexicon: Lexicon) -> str | None:
    """The frequent word that a space splits into ``left`` and ``right``, if these aren't both words."""
    a, c = left.lower(), _word(right)
    if not (left.isalpha() and c.isalpha() and right[: len(c)].lower() == c):
        return None
    whole = a + c
    if lexicon.known(a) and lexicon.known(c) and (lexicon.count(whole) < lexicon.ratio * max(lexicon.count(a), lexicon.count(c)) or {a, c} & lexicon.sure):
        return None
    if lexicon.known(whole) and whole not in lexicon.sure or whole in lexicon.counts:
        return whole
    if len(whole) > 5 and not (lexicon.known(a) or lexicon.known(c) or lexicon.links(a) or lexicon.links(c)):
        return next(iter(lexicon.links(whole)), None)
    return None


def _correct(b: Block, lexicon: Lexicon) -> None:
    """Set right the block's words that glyph edits link to others, and words with a space in them."""
    plain, tokens, words = lexicon.plain, lexicon.tokens, b.words
    if len(tokens) + len(plain) > 500_000:
        tokens.clear()
        plain.clear()
    odd = []
    for k in [k for k, w in enumerate(words) if w not in plain]:
        w = words[k]
        if w not in tokens:
            token = _token(w, lexicon)
            if token is None:
                plain.add(w)
                continue
            tokens[w] = token
        odd.append(k)
    if not odd:
        return
    gone: set[int] = set()
    fixed: dict[int, str] = {}
    for k in odd:
        if k in gone:
            continue
        for left in (k - 1, k):  # the odd part may be the second or the first half
            if left < 0 or left + 1 >= len(words) or left in gone or left + 1 in gone or left in fixed:
                continue
            whole = _two_parts(words[left], words[left + 1], lexicon)
            if whole:
                b.noise.add("glyph")
                second = words[left + 1]
                fixed[left] = (whole.capitalize() if words[left][:1].isupper() else whole) + second[len(_word(second)) :]
                gone.add(left + 1)
                break
        if k in gone or k in fixed or not tokens[words[k]].links:
            continue
        b.noise.add("glyph")
        w = words[k]
        near = [_word(x) for x in (*words[max(0, k - 2) : k], *words[k + 1 : k + 3])]
        for start, end, links in reversed(tokens[words[k]].links):
            best = lexicon.best(links, near)
            w = w[:start] + (best.capitalize() if w[start].isupper() and w[start + 1 : start + 2].islower() else best) + w[end:]
        fixed[k] = w
    b.words = [fixed.get(k, w) for k, w in enumerate(words) if k not in gone]


def repair_blocks(blocks: list[Block], lexicon: Lexicon, recurring: set[str] | None = None, taken: int = 0, ahead: str = "") -> None:
    """Blocks of one stretch of a document in reading order: find their noise, repair their words.

    ``taken`` characters of the first line belong to a word begun in the stretch before.
    """
    _furniture(blocks, recurring, lexicon.shapes)
    if taken:
        first = next(b for b in blocks if b.lines)
        first.lines[0] = first.lines[0][taken:]
    _read(blocks, lexicon, ahead)
    for b in blocks:
        _correct(b, lexicon)


_STRETCH = 16
_LONG = 2048
_WINDOW = ["doc_id", "stretch", "part"]
_AT = "doc_id string, stretch bigint, part bigint"


def _lines(text: str | None) -> list[str]:
    return [x for x in (text or "").splitlines() if x.strip()]


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch; strings are taken in bulk."""
    names = batch.schema.names
    columns = [c.to_numpy(zero_copy_only=False) if pa.types.is_string(c.type) else c.to_pylist() for c in batch.columns]
    return (dict(zip(names, values)) for values in zip(*columns))


def _by_window(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each window; they follow one another."""
    key, held = None, []
    for batch in batches:
        for r in _rows(batch):
            now = (r["doc_id"], r["stretch"], r["part"])
            if now != key and held:
                yield held
                held = []
            key = now
            held.append(r)
    if held:
        yield held


def _batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    done = []
    for r in rows:
        done.append(r)
        if len(done) >= 2000:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
            done = []
    yield pa.RecordBatch.from_pylist(done, schema=schema)


def _opened(rows: list[dict]) -> tuple[list[Block], list[dict], set[str] | None]:
    """The blocks of a window, each once, their rows, and what recurs in a document of several windows."""
    seen, blocks, own = set(), [], []
    for r in rows:
        if r["kind"] == "block" and r["block_id"] not in seen:
            seen.add(r["block_id"])
            blocks.append(Block(r["block_id"], r["page"], _lines(r["text"])))
            own.append(r)
    return blocks, own, {r["text"] for r in rows if r["kind"] == "a head"} if rows[-1]["several"] else None


def _several(rows: DataFrame) -> DataFrame:
    """``(doc_id, long)``: the documents of several windows."""
    start, part = _cuts()
    return materialize(rows.filter((start > 0) | (part > 0)).groupBy("doc_id").agg(F.max(part > 0).alias("long")), "scan-documents")


def _cuts() -> tuple[Column, Column]:
    return F.coalesce(F.floor(F.col("sec_idx") / _STRETCH), F.lit(0)), F.coalesce(F.floor(F.col("block_order") / _LONG), F.lit(0))


def _in_windows(rows: DataFrame, several: DataFrame) -> DataFrame:
    """``rows`` with the window each is in, ``(doc_id, stretch, part)`` in reading order, and whether
    its document has ``several``: 16 sections a window, or 2048 blocks of one section in a document
    with a longer one."""
    start, part = _cuts()
    long = F.coalesce("long", F.lit(False))
    return rows.join(several, "doc_id", "left").select(
        *rows.columns, F.when(long, F.coalesce("sec_idx", F.lit(0))).otherwise(start).cast("bigint").alias("stretch"),
        F.when(long, part).otherwise(F.lit(0)).cast("bigint").alias("part"), F.col("long").isNotNull().alias("several"),
    )


def _sorted_windows(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_WINDOW).sortWithinPartitions(*_WINDOW, "kind", "sec_idx", "block_order", "block_id")


def _told(rows: DataFrame, like: DataFrame) -> DataFrame:
    """``rows(doc_id, stretch, part, kind, text, …)`` as rows that stand before a window's blocks."""
    given = {"sec_idx": "int", "block_id": "string", "block_order": "int", "page": "int", "n": "bigint", "links": "array<string>"}
    missing = {c: F.lit(None).cast(t) for c, t in given.items() if c not in rows.columns}
    return rows.withColumns(missing | {"several": F.col("several") if "several" in rows.columns else F.lit(True)}).select(*like.columns)


def _heads(placed: DataFrame) -> DataFrame:
    """``(doc_id, stretch, part, kind, text)``: the edge lines of a window that recur in its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            found = [(r["doc_id"], r["stretch"], r["part"], p, inner) for r in rows for p, inner in _edges(_lines(r["text"]))]
            cols = list(zip(*found)) if found else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=[*_WINDOW, "text", "inner"])

    lines = placed.select(*_WINDOW, "text").mapInArrow(run, f"{_AT}, text string, inner string").withColumn("inner", F.xxhash64("inner"))
    each = lines.groupBy(*_WINDOW, "text").agg(F.min("inner").alias("low"), F.max("inner").alias("high"))
    whole = Window.partitionBy("doc_id", "text")
    recurs = each.withColumns({"low": F.min("low").over(whole), "high": F.max("high").over(whole)}).filter("low < high")
    return recurs.select(*_WINDOW, F.lit("a head").alias("kind"), "text")


def _boundaries(rows: DataFrame, shapes: frozenset[str]) -> DataFrame:
    """``(doc_id, stretch, part, kind, text)``: how many characters of a window's first line a word
    begun before it takes (``a taken``), and the word that follows the window (``a next``)."""
    ends = pa.schema([("doc_id", pa.string()), ("stretch", pa.int64()), ("part", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("alone", pa.bool_())])
    told = pa.schema([("doc_id", pa.string()), ("stretch", pa.int64()), ("part", pa.int64()), ("kind", pa.string()), ("text", pa.string())])

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for rows in _by_window(batches):
                blocks, _, recurring = _opened(rows)
                _furniture(blocks, recurring, shapes)
                lines = [x for b in blocks for x in b.lines]
                if lines:
                    last = lines[-1].split()[-1] if lines[-1].rstrip(" \t")[-1:] in _BREAKS else ""
                    first = re.match(r"\s*\S*", lines[0])[0]
                    yield {c: rows[0][c] for c in _WINDOW} | {"first": first, "last": last, "alone": len(lines) == 1 and len(lines[0].split()) == 1}

        return _batched(each(), ends)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            before, last = None, ""
            for batch in batches:
                for r in batch.to_pylist():
                    if before is None or before["doc_id"] != r["doc_id"]:
                        last = ""
                    second = _SECOND.match(r["first"]) if last and _BROKEN.search(last) else None
                    if second:
                        yield {c: before[c] for c in _WINDOW} | {"kind": "a next", "text": r["first"]}
                        yield {c: r[c] for c in _WINDOW} | {"kind": "a taken", "text": str(_TAIL.match(r["first"], second.end()).end())}
                    before, last = r, "" if second and r["alone"] else r["last"]

        return _batched(each(), told)

    found = _sorted_windows(rows).mapInArrow(outer, f"{_AT}, first string, last string, alone boolean")
    return found.repartition("doc_id").sortWithinPartitions(*_WINDOW).mapInArrow(meet, f"{_AT}, kind string, text string")


def _repaired(blocks: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row a block, with paragraphs as far as the window tells: ``lead`` rows belong to the paragraph
    that is open before it, if one is; the window's first row says how it ``ends``."""
    given = blocks.select("doc_id", "sec_idx", "block_id", "block_order", "page", "text")
    divided = _several(given)
    told = {"kind": F.lit("block"), "n": F.lit(None).cast("bigint"), "links": F.lit(None).cast("array<string>")}
    placed = _in_windows(given, divided).withColumns(told)
    several = placed.filter("several")
    heads = materialize(_heads(several), "scan-heads")
    met = materialize(_boundaries(several.unionByName(_told(heads, placed)), lexicon.shapes), "scan-boundaries")
    rows = placed.unionByName(_told(heads, placed)).unionByName(_told(met, placed))
    if lexicon.words is not None:
        asked = materialize(_asked(given, lexicon), "scan-pieces")
        where = _in_windows(asked.select("doc_id", "sec_idx", "block_order", "piece"), divided).select(*_WINDOW, "several", "piece").distinct()
        said = where.join(_answers(asked, lexicon), "piece").select(*_WINDOW, "several", F.lit("a word").alias("kind"), F.col("piece").alias("text"), "n", "links")
        rows = rows.unionByName(_told(said, placed))
    end = pa.struct([("through", pa.bool_()), ("open", pa.bool_()), ("paragraph", pa.string())])
    schema = pa.schema([
        ("doc_id", pa.string()), ("stretch", pa.int64()), ("part", pa.int64()), ("several", pa.bool_()), ("sec_idx", pa.int32()), ("block_order", pa.int32()), ("block_id", pa.string()),
        ("paragraph_id", pa.string()), ("page", pa.int32()), ("noise", pa.list_(pa.string())), ("text", pa.string()), ("lead", pa.bool_()), ("ends", end),
    ])

    def finish(rows: list[dict]) -> list[dict]:
        found, own, recurring = _opened(rows)
        if not found:
            return []
        lexicon.found = {r["text"]: (r["n"], r["links"]) for r in rows if r["kind"] == "a word"}
        told = {r["kind"]: r["text"] for r in rows if r["kind"] in ("a next", "a taken")}
        repair_blocks(found, lexicon, recurring, int(told.get("a taken", 0)), told.get("a next", ""))
        out, paragraph, open_, lead = [], None, None, True
        for b, r in zip(found, own):
            if not open_ or paragraph is None:
                paragraph = b.block_id
            text = " ".join(b.words)
            out.append({c: r[c] for c in (*_WINDOW, "several", "sec_idx", "block_order")} | {"block_id": b.block_id, "paragraph_id": paragraph, "page": b.page, "noise": sorted(b.noise), "text": text, "lead": lead})
            if text:
                open_ = text[-1:].isalnum() or text[-1:] in ",-"
                lead = lead and open_
        out[0]["ends"] = {"through": lead, "open": open_, "paragraph": paragraph}
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched((r for rows in _by_window(batches) for r in finish(rows)), schema)

    return _sorted_windows(rows).mapInArrow(
        run,
        f"{_AT}, several boolean, sec_idx int, block_order int, block_id string, paragraph_id string, page int, noise array<string>, text string, lead boolean, "
        "ends struct<through: boolean, open: boolean, paragraph: string>",
    )


def _open_before(ends: DataFrame) -> DataFrame:
    """``(doc_id, stretch, part, before)``: the paragraph that is open where a window starts."""
    schema = pa.schema([("doc_id", pa.string()), ("stretch", pa.int64()), ("part", pa.int64()), ("before", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            doc, paragraph, open_ = None, None, False
            for batch in batches:
                for r in batch.to_pylist():
                    if r["doc_id"] != doc:
                        doc, paragraph, open_ = r["doc_id"], None, False
                    if open_:
                        yield {c: r[c] for c in _WINDOW} | {"before": paragraph}
                    end = r["ends"]
                    if not (open_ and end["through"]):
                        paragraph = end["paragraph"]
                    open_ = open_ if end["open"] is None else end["open"]

        return _batched(each(), schema)

    return ends.select(*_WINDOW, "ends").repartition("doc_id").sortWithinPartitions(*_WINDOW).mapInArrow(run, f"{_AT}, before string")


def texts(blocks: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``repair`` without paragraphs: ``(block_id, noise, text)``."""
    return _repaired(blocks, lexicon).select("block_id", "noise", "text")


def repair(blocks: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``blocks(doc_id, sec_idx, block_id, block_order, page, text)`` to one row per block:
    ``(doc_id, sec_idx, block_order, block_id, paragraph_id, page, noise array<string>, text)``.

    ``text`` is repaired, on one line, without furniture; ``paragraph_id`` is the block its paragraph
    begins with: a block that ends within a sentence goes on in the next. Repeated blocks count once;
    null texts are empty. Work goes by windows of 16 sections of a document, so no document is gathered
    in one task. What crosses a window's start comes from small tables: the lines that recur in the
    document, the word broken there, and the paragraph open there.
    """
    rows = materialize(_repaired(blocks, lexicon), "repaired-blocks")
    before = _open_before(rows.filter("several and ends is not null"))
    columns = ("doc_id", "sec_idx", "block_order", "block_id", "paragraph_id", "page", "noise", "text")
    led = rows.filter("several and lead").join(before, _WINDOW, "left").withColumn("paragraph_id", F.coalesce("before", "paragraph_id"))
    return rows.filter("not (several and lead)").select(*columns).unionByName(led.select(*columns))
