"""Lines repeated across one source's documents (problem 4).

Lines are parsed into templates by a token tree of fixed depth: source, number
of tokens, first tokens, and below these the tokens of every place. Tokens are
words where words are spaced and single characters where they aren't; numbers
are one token. A token of a leaf's place that stands there in fewer than
``min_docs`` documents is a wildcard slot, so a leaf holds as many templates as
its lines leave when their rare tokens are slots: a byline becomes its words
around a slot for the name. What the tree counts are sums, so each partition
grows its own tree and the trees are merged in any order, leaf by leaf first
(leaves that cover too few documents go no further), then place by place.

A template covers the documents in which its lines stand. A covering template
(``min_docs`` documents or more) is a repeated line if at least ``share`` of its
tokens are constant and what varies is in one place (``slots``: a name, a date,
a page number); sentences of one form that carry several values are text.
``without_repeated_lines`` removes all lines of such templates.
``repeated_lines`` are the lines of covering templates that, each by itself,
stand in ``min_docs`` documents. A line that does is a template without slots,
as all of its tokens do, so none of them is lost.

Two lines are the same if they are equal in one form, letter case, all white
space and everything but letters and digits at either end put aside. Of the
spellings of one line that differ in white space, the one with the most words
is parsed; a leaf of the line without white space keeps lines whose spellings
are parsed to different leaves.

Defined results: rows of null source or content have no repeated lines; lines
that are empty by this rule don't count; a row repeated exactly counts once
(documents are counted by their id); texts of any length are treated whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.forms import LATIN_SPELLER, Speller, one_form
from lexmill.sources.shared import kept, sized

WILDCARD = "<*>"
NUMBER = "0"
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_DIGITS = re.compile(r"\d+")
_TOKEN = re.compile(r"[^\W\d_㐀-鿿぀-ヿ]+|\d+|\S")
_KEPT = 60_000  # parsed lines remembered by a task


def spelled(line: str, speller: Speller = LATIN_SPELLER) -> str:
    """The line in one form and lower case without what stands around its letters and digits."""
    form = one_form(line, speller).lower()
    return _EDGES.sub("", form) if form else ""


def line_key(line: str, speller: Speller = LATIN_SPELLER) -> str:
    """What a line is compared by; "" for lines that don't count."""
    return spelled(line, speller).replace(" ", "")


def tokens_of(form: str) -> list[str]:
    """Words of spaced scripts, all other characters singly, numbers as one token."""
    return [NUMBER if t[0].isdigit() else t for t in _TOKEN.findall(form)]


def _hashed(*parts: str) -> int:
    x = xxhash.xxh3_64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >> 63 else x


def _leaf(source: str, tokens: list[str], depth: int) -> int:
    return _hashed(source, str(len(tokens)), *tokens[:depth])


def parse_lines(df: DataFrame, key: str, source: str, text: str, depth: int = 2, speller: Speller = LATIN_SPELLER) -> DataFrame:
    """The lines and the partitions' trees in one pass; ``kind`` says what a row is.

    line: item_id, line_no, leaf, bare, k1, k2 (128 bits of source and line key);
    key: a partition's distinct lines, with leaf, bare, k1, k2, origin (of the
    source) and tokens; leaf: documents of a partition under a leaf. ``bare`` is
    the leaf of the line without white space.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], tuple] = {}
        documents: dict[int, int] = {}
        sent: set[tuple[int, int, int]] = set()
        for batch in batches:
            lines: list[tuple] = []
            keys: list[tuple] = []
            for item, origin, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                covered: set[int] = set()
                for number, line in enumerate(content.split("\n")):
                    found = known.get((origin, line))
                    if found is None:
                        found = ()
                        if form := spelled(line, speller):
                            own = form.replace(" ", "")
                            tokens = tokens_of(form)
                            masked = _DIGITS.sub(NUMBER, own)
                            digest = xxhash.xxh3_128_intdigest(f"{origin}\0{own}".encode("utf-8", "surrogatepass"))
                            k1, k2 = ((x - (1 << 64) if x >> 63 else x) for x in (digest >> 64, digest & (1 << 64) - 1))
                            found = (_leaf(origin, tokens, depth), _hashed(origin, "", str(len(masked)), masked[:6]), k1, k2)
                            if (node := (found[0], k1, k2)) not in sent:
                                if len(sent) >= 10 * _KEPT:
                                    sent.clear()
                                sent.add(node)
                                keys.append((*found, _hashed(origin), " ".join(tokens)))
                        if len(known) >= _KEPT:
                            known.clear()
                        if len(line) < 400:
                            known[origin, line] = found
                    if found:
                        covered.update(found[:2])
                        lines.append((item, number, *found))
                for leaf in covered:
                    documents[leaf] = documents.get(leaf, 0) + 1
            yield _rows("line", lines, ("item_id", "line_no", "leaf", "bare", "k1", "k2"))
            yield _rows("key", keys, ("leaf", "bare", "k1", "k2", "origin", "tokens"))
        yield _rows("leaf", list(documents.items()), ("leaf", "docs"))

    picked = df.select(F.col(key).cast("string").alias("item_id"), F.col(source).cast("string").alias("origin"), F.col(text).alias("content"))
    picked = picked.where("item_id is not null and origin is not null and content is not null and content <> ''")
    return picked.mapInArrow(parse, "kind string, item_id string, line_no int, leaf bigint, bare bigint, k1 bigint, k2 bigint, origin bigint, tokens string, docs bigint")


_KINDS = {
    "kind": pa.string(), "item_id": pa.string(), "line_no": pa.int32(), "leaf": pa.int64(), "bare": pa.int64(), "k1": pa.int64(), "k2": pa.int64(),
    "origin": pa.int64(), "tokens": pa.string(), "docs": pa.int64(),
}


def _rows(kind: str, rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    columns = dict(zip(names, zip(*rows))) if rows else {}
    columns["kind"] = [kind] * len(rows)
    arrays = [pa.array(columns[n], t) if n in columns else pa.nulls(len(rows), t) for n, t in _KINDS.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(_KINDS))


class LineTemplates:
    """The merged tree of a table's lines and its covering templates."""

    def __init__(self, df: DataFrame, key: str, source: str, text: str, min_docs: int = 10, depth: int = 2, share: float = 0.7, slots: int = 1) -> None:
        self.min_docs, self.depth, self.share, self.slots = min_docs, depth, share, slots
        parsed = parse_lines(df, key, source, text, depth).persist()
        # a document stored several times may count as often here; lines and templates are counted exactly below
        leaves = sized(parsed.where("kind = 'leaf'").groupBy("leaf").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("leaf"))
        lines = self._under(parsed.where("kind = 'line'").select("item_id", "line_no", "leaf", "bare", "k1", "k2"), leaves)
        self.lines = kept(lines.groupBy("k1", "k2", "item_id").agg(F.collect_set("line_no").alias("numbers")))
        of_line = self.lines.groupBy("k1", "k2").agg(F.count("*").alias("docs"))
        spellings = self._under(parsed.where("kind = 'key'").select("leaf", "bare", "k1", "k2", "origin", "tokens"), leaves)
        fullest = F.struct(F.size(F.split("tokens", " ")), "tokens")
        forms = spellings.groupBy("k1", "k2").agg(F.max_by("tokens", fullest).alias("tokens"), F.min("origin").alias("origin"))
        self.members = sized(self._members(forms.join(of_line, ["k1", "k2"])))

    @staticmethod
    def _under(rows: DataFrame, leaves: DataFrame) -> DataFrame:
        """Rows of which one of the two leaves is among ``leaves``."""
        hint = leaves.select(F.col("leaf"), F.lit(True).alias("__a"))
        bare = leaves.select(F.col("leaf").alias("bare"), F.lit(True).alias("__b"))
        return rows.join(hint, "leaf", "left").join(bare, "bare", "left").where("__a or __b").drop("__a", "__b")

    def _members(self, forms: DataFrame) -> DataFrame:
        """k1, k2, docs (of the line), leaf, template, covers: every line of a covering template."""
        least = self.min_docs
        token = F.split("tokens", " ")
        leaf = F.xxhash64("origin", F.size(token), *(F.get(token, F.lit(i)) for i in range(self.depth)))
        forms = kept(forms.withColumn("leaf", leaf))
        wide = forms.groupBy("leaf").agg(F.sum("docs").alias("n")).where(F.col("n") >= least).select("leaf")
        placed = forms.join(sized(wide), "leaf", "left_semi").select("k1", "k2", "leaf", "docs", F.posexplode(token).alias("place", "token"))
        nodes = placed.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("n")).where(F.col("n") >= least)
        known = sized(nodes.select("leaf", "place", "token", F.lit(True).alias("__often")))
        marked = placed.join(known, ["leaf", "place", "token"], "left").withColumn("token", F.when(F.col("__often"), F.col("token")).otherwise(WILDCARD))
        whole = marked.groupBy("k1", "k2").agg(
            F.first("leaf").alias("leaf"), F.first("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("place", "token")))["token"].alias("t"),
        )
        constant = F.size(F.filter("t", lambda x: ~x.isin(WILDCARD, NUMBER))) / F.size("t")
        # slots and constant words in a row; punctuation stands for neither
        row = F.array_join(F.transform("t", lambda x: F.when(x.isin(WILDCARD, NUMBER), "s").when(F.rlike(x, F.lit(r"[\p{L}\p{N}]")), "c").otherwise("")), "")
        sure = ((constant >= self.share) & (F.regexp_count(row, F.lit("s+")) <= self.slots)) | (F.col("docs") >= least)
        shaped = whole.where(sure).select("k1", "k2", "leaf", "docs", F.array_join("t", " ").alias("template"), F.xxhash64("leaf", "t").alias("template_id"))
        shaped = kept(shaped)
        # sums over lines bound what a template covers; only templates of several lines are counted by document
        several = shaped.groupBy("template_id").agg(F.sum("docs").alias("most"), F.max("docs").alias("one"))
        open_ = several.where((F.col("most") >= least) & (F.col("most") > F.col("one"))).select("template_id")
        of_item = self.lines.select("k1", "k2", "item_id").join(sized(shaped.join(open_, "template_id", "left_semi").select("k1", "k2", "template_id")), ["k1", "k2"])
        counted = of_item.select("template_id", "item_id").distinct().groupBy("template_id").agg(F.count("*").alias("covers"))
        single = several.where((F.col("most") >= least) & (F.col("most") == F.col("one"))).select("template_id", F.col("one").alias("covers"))
        covering = counted.unionByName(single).where(F.col("covers") >= least)
        return shaped.join(sized(covering), "template_id")

    def templates(self) -> DataFrame:
        """leaf, template, docs: the covering templates and how many documents each covers."""
        return self.members.select("leaf", "template", F.col("covers").alias("docs")).distinct()

    def covered_lines(self) -> DataFrame:
        """item_id, line_no of every line of a covering template."""
        return self.lines.join(self.members.select("k1", "k2"), ["k1", "k2"], "left_semi").select("item_id", F.explode("numbers").alias("line_no"))

    def repeated_lines(self) -> DataFrame:
        """item_id, line_no of every line of a covering template that by itself stands in ``min_docs`` documents of its source."""
        often = self.members.where(F.col("docs") >= self.min_docs).select("k1", "k2")
        return self.lines.join(often, ["k1", "k2"], "left_semi").select("item_id", F.explode("numbers").alias("line_no"))


def without_repeated_lines(df: DataFrame, key: str, source: str, text: str, to: str, min_docs: int = 10) -> DataFrame:
    """``df`` with ``text`` without the lines of covering templates in the new column ``to``; all rows and columns stay."""
    found = LineTemplates(df, key, source, text, min_docs).covered_lines()
    drop = found.groupBy("item_id").agg(F.collect_set("line_no").alias("__lines"))
    joined = df.join(drop.withColumnRenamed("item_id", "__item"), F.col(key).cast("string") == F.col("__item"), "left")
    kept = F.filter(F.split(F.col(text), "\n", -1), lambda line, i: ~F.array_contains(F.col("__lines"), i))
    mine = F.col("__lines").isNotNull() & F.col(source).isNotNull()
    return joined.withColumn(to, F.when(mine, F.array_join(kept, "\n")).otherwise(F.col(text))).drop("__lines", "__item")
