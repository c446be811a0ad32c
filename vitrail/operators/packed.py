"""Several values packed in one text field, split into one row per value with its position.

Splitting is dictionary-guided. A first pass over all fields counts whole values that are certain: pieces that
are quoted, escaped or listed, and pieces between delimiters. The frequent ones make the dictionary, with their counts. A second pass runs a multi-pattern
automaton of the known values over every field of several unprotected pieces, and dynamic programming chooses, of the covers of the field by
known values and unknown pieces, the one of fewest unknown and then of fewest pieces. A known value across delimiters may be a piece if it is known better
than the least known of its parts; else its delimiters separate, as they do for a field of known parts.

A dictionary of more than ``max_entries`` isn't broadcast: then the fields' possible pieces meet the dictionary in a join, and the same programme chooses.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrail.sources.tables import cut

DELIMITERS = ",;|\n\r\t•·、；，"
QUOTES = {'"': '"', "'": "'", "“": "”", "„": "“", "«": "»", "‘": "’"}
_DELIMITER_SET = frozenset(DELIMITERS)
_DELIMITER = re.compile(f"[{re.escape(DELIMITERS)}]")
#: What a field without any of these is split at needs no look at each character.
_PROTECTS = re.compile(f"[{re.escape(''.join(QUOTES))}{re.escape(chr(92))}\\[]")
_ESCAPABLE = _DELIMITER_SET | frozenset("\\\"'“”[]")


def _closing(text: str, start: int, end: int, close: str) -> tuple[int, str] | None:
    """The place after the quote that ends a value begun at ``start``, and the value; None if it isn't closed."""
    out: list[str] = []
    i = start
    while i < end:
        c = text[i]
        if c == "\\" and i + 1 < end and (text[i + 1] in _ESCAPABLE):
            out.append(text[i + 1])
            i += 2
            continue
        if c == close:
            if i + 1 < end and text[i + 1] == close:
                out.append(close)
                i += 2
                continue
            j = i + 1
            while j < end and text[j].isspace() and text[j] not in _DELIMITER_SET:
                j += 1
            if j == end or text[j] in _DELIMITER_SET:
                return j, "".join(out)
        out.append(c)
        i += 1
    return None


def atoms(text: str) -> list[tuple[str, str, bool]]:
    """The field cut at every unprotected delimiter: (value, raw text with the delimiter that follows, certain).

    ``certain`` marks quoted and escaped pieces; these are never joined with neighbours. Blank pieces stay
    as empty values, for they separate.
    """
    start, end = 0, len(text)
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    listed = end - start >= 2 and text[start] == "[" and text[end - 1] == "]"
    if listed:
        start, end = start + 1, end - 1
    out: list[tuple[str, str, bool]] = []
    i = start
    while i < end:
        began = i
        while i < end and text[i].isspace() and text[i] not in _DELIMITER_SET:
            i += 1
        if i < end and text[i] in QUOTES and (got := _closing(text, i + 1, end, QUOTES[text[i]])):
            i, value = got
            i += 1
            out.append((value.strip(), text[began:i], True))
            continue
        chars: list[str] = []
        escaped = False
        while i < end and text[i] not in _DELIMITER_SET:
            if text[i] == "\\" and i + 1 < end and text[i + 1] in _ESCAPABLE:
                chars.append(text[i + 1])
                escaped = True
                i += 2
            else:
                chars.append(text[i])
                i += 1
        i += 1
        out.append(("".join(chars).strip(), text[began:i], escaped or listed))
    return out


def pieces(text: str) -> list[tuple[str, str, bool]]:
    """``atoms``; a field without quotes, escapes and list brackets is cut by one regular expression."""
    if _PROTECTS.search(text):
        return atoms(text)
    text = text.strip()
    ends = [m.end() for m in _DELIMITER.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    out, begin = [], 0
    for end in ends:
        raw = text[begin:end]
        out.append((raw.rstrip(DELIMITERS).strip() if raw[-1:] in _DELIMITER_SET else raw.strip(), raw, False))
        begin = end
    return out if text else []


def certain_values(text: str) -> list[str]:
    """Folded values of a field as evidence for the dictionary: protected pieces, and bare pieces between delimiters for themselves."""
    return [v.lower() for v, _, _ in pieces(text) if v]


def best_cover(parts: list[tuple[str, str, bool]], spans: Iterable[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(first, last) of the pieces of the best cover of ``parts``: fewest unknown pieces, then fewest pieces, then those that begin latest.

    ``spans`` (first, last, count) are the known values among the runs of parts that aren't protected; parts that no span names are unknown.
    """
    count = {(a, b): n for a, b, n in spans}
    longer: dict[int, list[int]] = {}
    for (a, b), n in count.items():
        if b > a and n > min(count.get((k, k), 0) for k in range(a, b + 1) if parts[k][0]):
            longer.setdefault(b, []).append(a)
    best: list[tuple[int, int, int]] = [(0, 0, 0)]  # unknown pieces, pieces, the part less one that the last piece begins with
    for k, (value, _, certain) in enumerate(parts):
        unknown, n, _ = best[k]
        options = [(unknown + bool(value and not certain and (k, k) not in count), n + bool(value), -k)]
        options += [(best[a][0], best[a][1] + 1, -a) for a in longer.get(k, ())]
        best.append(min(options))
    out, k = [], len(parts)
    while k:
        a = -best[k][2]
        out.append((a, k - 1))
        k = a
    return out[::-1]


def covered(parts: list[tuple[str, str, bool]], spans: Iterable[tuple[int, int, int]]) -> list[str]:
    """The values of the best cover, in order."""
    out = []
    for a, b in best_cover(parts, spans):
        value = parts[a][0] if a == b else "".join(raw for _, raw, _ in parts[a : b + 1]).strip().strip(DELIMITERS).strip()
        if value:
            out.append(value)
    return out


class Segmenter:
    """Splits fields with a dictionary of folded whole values, and their counts where it has them."""

    def __init__(self, values: dict[str, int] | Iterable[str]):
        self.known = dict(values) if isinstance(values, dict) else dict.fromkeys(values, 1)
        self.automaton = None
        if any(c in _DELIMITER_SET for v in self.known for c in v):
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for v, n in self.known.items():
                self.automaton.add_word(v, (len(v), n))
            self.automaton.make_automaton()

    def split(self, text: str | None) -> list[str]:
        """The values of a field, in order; none for a null, empty or blank field."""
        if not text:
            return []
        parts = pieces(text)
        # One piece, or none but protected ones, has one cover; so has every field if no known value holds a delimiter.
        if self.automaton is None or sum(not p[2] for p in parts) < 2:
            return [v for v, *_ in parts if v]
        return covered(parts, self._spans(parts))

    def _spans(self, parts: list[tuple[str, str, bool]]) -> list[tuple[int, int, int]]:
        """The known values that the automaton finds from the start of a part to the end of a part, with no protected part among them."""
        text = "".join(raw for _, raw, _ in parts)
        folded = text.lower()
        if len(folded) != len(text):  # a letter that grows when folded: each is folded alone, and those that grow stay
            folded = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        starts, ends, at = {}, {}, 0
        for k, (value, raw, certain) in enumerate(parts):
            if not certain and value:
                lead = len(raw) - len(raw.lstrip())
                starts[at + lead] = k
                ends[at + lead + len(value)] = k
            at += len(raw)
        sure = [0]
        for p in parts:
            sure.append(sure[-1] + p[2])
        found = []
        for last, (length, n) in self.automaton.iter(folded):
            b = ends.get(last + 1)
            if b is not None:
                a = starts.get(last + 1 - length)
                if a is not None and a <= b and sure[a] == sure[b + 1]:
                    found.append((a, b, n))
        return found


def known_values(df: DataFrame, column: str, min_count: int = 3) -> DataFrame:
    """(value, n): folded values that occur at least ``min_count`` times as certain pieces, written to the checkpoint folder.

    Counted over all rows; values are pre-counted in each batch before they are shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(certain_values(text))
            yield pa.RecordBatch.from_pydict({"value": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    counted = df.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).mapInArrow(count, "value string, n bigint")
    return cut(counted.groupBy("value").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))


def _rows(split, batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row (_id, pos, keyword) for each value that ``split`` makes of each row, given by its number."""
    rows, pos, words = [], [], []
    for k in range(batch.num_rows):
        values = split(k)
        rows += [k] * len(values)
        pos += range(1, len(values) + 1)
        words += values
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pos, pa.int32()), pa.array(words, pa.string())], ["_id", "pos", "keyword"])


def _by_join(slim: DataFrame, known: DataFrame, schema: str) -> DataFrame:
    """The split of (_id, _text) by a dictionary too large to broadcast.

    Every distinct text gives its possible pieces, runs of as many parts as any known value has at most; these meet the dictionary in a join, come
    together by text again, and the cover is chosen from them.
    """
    inner = known.select((F.length("value") - F.length(F.translate("value", DELIMITERS, ""))).alias("n")).agg(F.max("n")).first()[0] or 0

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, first, last, values = [], [], [], []
            for text in batch.column(0).to_pylist():
                parts = pieces(text) if text else []
                if sum(not p[2] for p in parts) < 2:
                    continue
                for a in range(len(parts)):
                    run = ""
                    for b in range(a, min(len(parts), a + inner + 1)):
                        if parts[b][2]:
                            break
                        run += parts[b][1]
                        if parts[a][0] and parts[b][0]:
                            texts.append(text), first.append(a), last.append(b)
                            values.append(parts[a][0].lower() if a == b else run.strip().rstrip(DELIMITERS).strip().lower())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(values, pa.string())], ["_text", "a", "b", "value"])

    spans = slim.select("_text").distinct().mapInArrow(candidates, "_text string, a int, b int, value string").join(known, "value")
    grouped = spans.groupBy("_text").agg(F.collect_list(F.struct("a", "b", "n")).alias("spans"))
    with_spans = slim.join(grouped, "_text", "left").select("_id", "_text", "spans")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            yield _rows(lambda k: covered(pieces(texts[k]), [(x["a"], x["b"], x["n"]) for x in found[k] or ()]) if texts[k] else [], batch)

    return with_spans.mapInArrow(split, schema)


def split_packed(df: DataFrame, id_column: str, column: str, min_count: int = 3, max_entries: int = 200_000) -> DataFrame:
    """(id_column, pos int, keyword string): one row per value of the packed field, pos from 1 in field order.

    Null, empty, blank and empty-list fields give no row. Empty pieces take no place. Rows with a repeated or null id are split each
    for themselves; repeated values are kept. Other columns of ``df`` don't matter. An empty table gives an empty result. The dictionary is broadcast if it has no
    more than ``max_entries``, else joined, with the same result.
    """
    known = known_values(df, column, min_count)
    slim = df.select(F.col(id_column).alias("_id"), F.col(column).cast("string").alias("_text")).where(F.col("_text").isNotNull())
    schema = f"_id {slim.schema['_id'].dataType.simpleString()}, pos int, keyword string"
    listed = known.limit(max_entries + 1).toArrow()
    if listed.num_rows > max_entries:
        return _by_join(slim, known, schema).withColumnRenamed("_id", id_column)
    shared = df.sparkSession.sparkContext.broadcast(dict(zip(listed.column("value").to_pylist(), listed.column("n").to_pylist())))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield _rows(lambda k: segmenter.split(texts[k]), batch)

    return slim.mapInArrow(split, schema).withColumnRenamed("_id", id_column)
