"""Noise in text from scanned pages (problem 3).

Three kinds of noise are found line by line, and repaired:

- page furniture: digits are masked and lines reduced to a template of skeletons,
  in which glyphs that scans confuse are one and punctuation is left out. A line
  is furniture if it is a page number; if it repeats its document's title or file
  name; if its template recurs in two or more scanned sources, the same in each,
  while (nearly) no unscanned source has such lines; or if it recurs on a large
  share of one scanned source's rows and in no unscanned source. A line that
  lost, gained or changed one character of such a template counts too. A running
  header or footer is a line of at most 80 characters that isn't a sentence; one
  without digits stands among the first or last two lines of its row;
- misread words: words of the corpus are grouped by confusable-glyph skeleton; a
  frequent form of a group replaces a rare one where both stand beside the same
  neighbouring words, of several forms the one with the most such neighbours.
  Han characters, which aren't written in words, are compared with the characters
  they are confused with by the counts of the pairs they form with their
  neighbours;
- broken words: a hyphen ends a line and the word goes on in the next line of
  text (furniture and at most ``REACH`` lines between); the joined word must be
  one of the corpus (as it is, or by skeleton; of several the most frequent).

All counts are made over the whole corpus in one pass of partial sums. A source
counts as scanned if page number lines or broken words are frequent in it. The
candidates of scanned sources are then joined with the accepted forms.

Defined results: null, empty and blank contents and null sources have no noise;
a row repeated exactly counts once; texts of any length are treated whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.forms import LATIN_OF, has_foreign_letters, one_form, without_ignorable
from lexmill.sources.shared import kept, sized

# --- fixed values: glyphs that scans take for one another --------------------
#: Latin letters and digits, as the strokes they are confused by.
STROKES = {
    "b": "ii", "d": "ci", "e": "c", "f": "t", "g": "9", "h": "ii", "i": "i", "l": "i", "1": "i", "|": "i", "m": "rn",
    "o": "0", "s": "5", "u": "ii", "w": "vv", "z": "2", "q": "9", "é": "c", "è": "c", "ö": "0", "ü": "ii", "á": "a", "ù": "ii", "å": "a",
}
#: Strokes by which one glyph is written above.
PAIRS = ("ii", "ci", "rn", "vv")
#: Han characters of like shape.
HAN_ALIKE = (
    "壓厭", "顯顥", "換喚", "測側", "度庋", "滑猾", "清請情", "頭頗", "間問", "記訂", "電雷", "載戴", "鎖銷", "軸釉",
    "熱熟", "絲緣", "輪輸", "具貝", "風鳳", "達逹", "端瑞", "氣氧", "片斤", "油抽", "檢撿", "己已巳", "未末", "土士",
    "日曰", "千干", "大太犬", "人入八", "王玉", "白自", "木本", "烏鳥", "免兔", "戊戌戍", "待侍", "徵微", "候侯", "買賣",
    "折拆", "晴睛", "幣弊", "編偏遍", "綠緣", "即郎", "科料", "住往", "閉閒", "開閑", "連違", "運連", "水氷",
    "刀力", "工土", "九丸", "冶治", "沖仲", "洗冼", "准淮", "拔拨", "按接", "技枝", "材村", "板扳", "標漂", "桿捍",
)
#: Marks by which a scan's line ends within a word.
BREAKS = "-­¬‐‑"
# -----------------------------------------------------------------------------

_HAN_OF: dict[str, str] = {}
for _group in HAN_ALIKE:
    for _c in _group:
        _HAN_OF[_c] = _HAN_OF.get(_c, "") + _group.replace(_c, "")
_HAN_SKELETON = {c: min(c, *others) for c, others in _HAN_OF.items()}
_SKELETON = str.maketrans({**STROKES, **_HAN_SKELETON})

_WORD = re.compile(r"[A-Za-z0-9À-ɏ]+")
_CODE = re.compile(r"[A-Z]{1,3}\d[A-Z\d]*")
_PLAUSIBLE = re.compile(r"(?=(?:[^a-zà-ɏ]*[a-zà-ɏ]){3})[A-Za-zÀ-ɏ]?[a-zà-ɏ012589]+|[A-Za-zÀ-ɏ]+")
_BROKEN = re.compile(rf"([A-Za-zÀ-ɏ0-9]+)[{BREAKS}][ \t]*$")
_GOES_ON = re.compile(r"[ \t]*([a-zà-ɏ0-9]+)")
_BROKEN_PAIR = re.compile(rf"[A-Za-zÀ-ɏ0-9]+[{BREAKS}][ \t]*\n[ \t]*[a-zà-ɏ0-9]+")
_SENTENCE = re.compile(r"[。，；！？]|[A-Za-zÀ-ɏ]{4}[.?!;](?=\s)|[.?!,;]$|,")
_DIGIT = r"[02-9i]"  # in skeletons
_PAGE_LINE = re.compile(
    rf"[\W_]*(?:(?:pa9c|p9|p)\b)?[\W_]*({_DIGIT}{{1,4}})(?:[\W_]*(?:/|0t)[\W_]*{_DIGIT}{{1,4}})?[\W_]*"
    rf"|第?\W*({_DIGIT}{{1,4}})\W*頁(?:\W*共\W*{_DIGIT}{{1,4}}\W*頁)?|頁\W*({_DIGIT}{{1,4}})(?:\W*共\W*{_DIGIT}{{1,4}}\W*頁)?"
)
_VALUE = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{1,3}[^\w\s]{0,2}\d(?:[A-Za-z0-9.-]*\d)?[A-Za-z]?(?![a-z])|(?<![^\W\d_])[\d.]*\d(?![^\W\d_])")
_END_NUMBER = re.compile(r"^[\W_]*\d{1,4}(?=[\s|])|(?<=[\s|])\d{1,4}[\W_]*$")
_MASKS = re.compile(r"[^\w#]+|_+")
_BAR = re.compile(r"(?<!\w)\|(?!\w)")
#: Longest line that may be a running header or footer, shortest template (bytes) that is compared with a character's tolerance.
LONGEST, TOLERANT = 80, 10
#: Lines within which a broken word goes on.
REACH = 5
_HAN = f"[{''.join(_HAN_OF)}]"
_HAN_PLACE = re.compile(f"(?=(.){_HAN}(.))")
_NOT_HAN = re.compile(r"[^㐀-鿿]+")


def skeleton(text: str) -> str:
    """The text in lower case with every glyph replaced by the strokes it may be confused by."""
    return text.lower().translate(_SKELETON)


def _template(form: str) -> str:
    masked = re.sub("#+", "#", _MASKS.sub("", skeleton(_VALUE.sub("#", form))))
    return masked.strip("#")


def line_shape(line: str, edge: bool = False) -> tuple[str, str] | None:
    """Skeleton (without a page number at its ends) and masked template of a line that could be furniture, else None.

    ``edge`` says that the line is among the first or last of its row, where it
    needn't have digits.
    """
    if "。" in line or "，" in line or "," in line:  # a sentence in any form
        return None
    form = _BAR.sub(" ", one_form(line)).strip()
    if not form or len(form) > LONGEST or _SENTENCE.search(form) or not (edge or any(c.isdigit() for c in form)):
        return None
    template = _template(form)
    if not template:
        return None
    return _MASKS.sub("", skeleton(_END_NUMBER.sub("", form))), template


def title_shapes(*names: str | None) -> set[str]:
    """Skeletons of a title or file name as headers repeat them; a file name also without a number that it ends in."""
    out = set()
    for name in names:
        if name:
            whole = re.sub(r"\.[A-Za-z0-9]{2,4}$", "", name).replace("_", " ")
            for part in (whole, re.sub(r"\s+[A-Za-z]{0,3}\d+$", "", whole)):
                shape = _MASKS.sub("", skeleton(one_form(part)))
                if len(shape.encode()) >= TOLERANT:
                    out.add(shape)
    return out


def one_off(text: str, glyphs: bool = False) -> list[str]:
    """The text, and all it could be without one of its characters (``glyphs``: or of its glyphs of two strokes); short texts only themselves."""
    if len(text.encode("utf-8", "surrogatepass")) < TOLERANT:
        return [text]
    out = [text, *(text[:i] + text[i + 1 :] for i in range(len(text)))]
    if glyphs:
        out += [text[:i] + text[i + 2 :] for i in range(len(text) - 1) if text[i : i + 2] in PAIRS]
    return list(dict.fromkeys(out))


def edges_of(lines: list[str]) -> set[int]:
    """The first and last two lines that aren't blank."""
    filled = [i for i, line in enumerate(lines) if line.strip()]
    return {*filled[:2], *filled[-2:]}


_LATIN = str.maketrans(LATIN_OF)


def _spelled(text: str) -> str:
    """The text without invisible characters, look-alike letters as Latin ones."""
    if text.isascii():
        return text
    text = without_ignorable(text)
    return text.translate(_LATIN) if has_foreign_letters(text) else text


def is_page_line(line: str, page: int | None) -> bool:
    """Whether a line is nothing but a page number."""
    if len(line) > 40 or not any(c.isalnum() for c in line):
        return False
    form = one_form(line)
    m = _PAGE_LINE.fullmatch(skeleton(form))
    if not m or not any(c.isdigit() for c in form):
        return False
    digits = next(g for g in m.groups() if g)
    if form.isdigit() and page is not None:
        return abs(int(digits.replace("i", "1")) - page) <= 5
    return True


class _Masked(dict):
    """Words as they are counted: lower case; codes and numbers as ``#``."""

    def __missing__(self, word: str) -> str:
        shown = "#"
        if not _CODE.fullmatch(word) and _PLAUSIBLE.fullmatch(word) and sum(c.isdigit() for c in word) <= 2 and any(c.isalpha() for c in word):
            shown = word.lower()
        if len(self) < 300_000:
            self[word] = shown
        return shown


def _joined_lines(lines: list[str]) -> tuple[str, list[int]]:
    """Text without white space, and the line of each character."""
    parts = ["".join(line.split()) for line in lines]
    return "".join(parts), [i for i, p in enumerate(parts) for _ in p]


def _han_context(text: str) -> str:
    """Everything that isn't Han as one mark, of the same length."""
    return "#" + _NOT_HAN.sub(lambda m: "#" * len(m[0]), text) + "#"


def corpus_counts(df: DataFrame, key: str, source: str, page: str, text: str) -> DataFrame:
    """kind, a, b, n: all partial counts in one pass.

    evidence: source, page_line | broken | chunk; line: source, template NUL
    skeleton; words: left neighbour, word; han: trigram around a character that
    has look-alikes. Lines count once for each row.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence, shapes, words, han = Counter(), Counter(), Counter(), Counter()
        masked = _Masked()
        for batch in batches:
            for origin, number, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                # the halves of broken words are no words
                whole = _spelled(_BROKEN_PAIR.sub(" # ", content))
                words.update(zip((tokens := [masked[w] for w in _WORD.findall(whole)]), tokens[1:]))
                if tokens:
                    words["#", tokens[0]] += 1
                if not content.isascii():
                    squeezed = _han_context("".join(content.split()))
                    for m in _HAN_PLACE.finditer(squeezed):
                        i = m.start()
                        han[squeezed[i : i + 3]] += 1
                if origin is None:
                    continue
                evidence[origin, "chunk"] += 1
                seen: set[tuple[str, str]] = set()
                lines = content.split("\n")
                edges = edges_of(lines)
                for i, line in enumerate(lines):
                    if is_page_line(line, number):
                        evidence[origin, "page_line"] += 1
                    elif len(line) <= 2 * LONGEST and (shape := line_shape(line, i in edges)) is not None:
                        seen.add(shape)
                    elif i + 1 < len(lines) and _BROKEN.search(line) and _GOES_ON.match(lines[i + 1]):
                        evidence[origin, "broken"] += 1
                for shape, template in seen:
                    shapes[origin, f"{template}\0{shape}"] += 1
        rows = [("evidence", a, b, n) for (a, b), n in evidence.items()]
        rows += [("line", a, b, n) for (a, b), n in shapes.items()]
        rows += [("words", a, b, n) for (a, b), n in words.items() if (a, b) != ("#", "#")]
        rows += [("han", t, None, n) for t, n in han.items()]
        for at in range(0, len(rows), 100_000):
            columns = list(zip(*rows[at : at + 100_000]))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:3]), pa.array(columns[3], pa.int64())], names=["kind", "a", "b", "n"])

    picked = df.select(F.col(source).cast("string").alias("s"), F.col(page).cast("int").alias("p"), F.col(text).alias("t")).where("t is not null and t <> ''")
    partial = picked.mapInArrow(count, "kind string, a string, b string, n bigint")
    return partial.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def scanned_sources(counts: DataFrame, share: float = 0.05, least: int = 2, alone: float = 0.3) -> DataFrame:
    """source: those whose page number lines and broken words are ``least`` or more and frequent, or fewer but on many rows."""
    of = counts.where("kind = 'evidence'").groupBy(F.col("a").alias("source")).agg(
        F.sum(F.when(F.col("b") != "chunk", F.col("n")).otherwise(0)).alias("signs"), F.sum(F.when(F.col("b") == "chunk", F.col("n")).otherwise(0)).alias("chunks")
    )
    frequent = (F.col("signs") >= least) & (F.col("signs") >= share * F.col("chunks"))
    return of.where(frequent | ((F.col("signs") >= 1) & (F.col("signs") >= alone * F.col("chunks")))).select("source")


def furniture_templates(counts: DataFrame, scanned: DataFrame, share: float = 0.3) -> DataFrame:
    """source (null: any), template: line templates of running headers and footers.

    Such a line is the same on page after page of a scanned source, in several of
    them, and (nearly) no unscanned source has lines of its template; or it stands
    in at least ``share`` of one scanned source's rows and in no unscanned source.
    """
    lines = counts.where("kind = 'line'").select(F.col("a").alias("s"), F.substring_index("b", "\0", 1).alias("template"), "n")
    of = lines.groupBy("s", "template").agg(F.sum("n").alias("lines"), F.max("n").alias("same"))
    marked = of.join(scanned.withColumn("scan", F.lit(1)), F.col("s") == F.col("source"), "left").drop("source")
    scan = F.col("scan") == 1
    again = scan & (F.col("lines") >= 2)
    per = marked.groupBy("template").agg(
        F.count("scan").alias("scans"), (F.count("*") - F.count("scan")).alias("others"), F.sum(F.when(scan, F.col("lines"))).alias("lines"),
        F.count(F.when(again, 1)).alias("running"), F.sum(F.when(again, F.col("lines"))).alias("again"), F.sum(F.when(again, F.col("same"))).alias("same"),
    ).where(F.length(F.regexp_replace("template", "[^\\p{L}]", "")) >= 3)
    running = "running >= 2 and others <= 0.25 * scans and again >= 0.5 * lines and again >= 3 * running and same >= 0.7 * again"
    everywhere = per.where(running).select(F.lit(None).cast("string").alias("source"), "template")
    rows = counts.where("kind = 'evidence' and b = 'chunk'").select(F.col("a").alias("s"), F.col("n").alias("chunks"))
    own = marked.where(scan & (F.col("same") >= 3)).join(rows, "s").where(F.col("same") >= share * F.col("chunks"))
    alone = own.join(per.where("others = 0").select("template"), "template", "left_semi").select(F.col("s").alias("source"), "template")
    return everywhere.unionByName(alone)


def furniture_keys(templates: DataFrame) -> DataFrame:
    """key (NUL template, or NUL template NUL source) of the templates and all they could be without one character."""
    off = F.pandas_udf(lambda s: s.map(lambda t: one_off(t, glyphs=True)), "array<string>")
    tail = F.coalesce(F.concat(F.lit("\0"), "source"), F.lit(""))
    return templates.select(F.explode(off("template")).alias("t"), tail.alias("tail")).select(F.concat(F.lit("\0"), "t", "tail").alias("key")).distinct()


def with_furniture(scanned: DataFrame, counts: DataFrame, templates: DataFrame) -> DataFrame:
    """source: ``scanned`` and the sources that have lines of a header's or footer's template."""
    lines = counts.where("kind = 'line'").select(F.col("a").alias("source"), F.substring_index("b", "\0", 1).alias("template"))
    return scanned.unionByName(lines.join(templates.where("source is null").select("template"), "template", "left_semi").select("source")).distinct()


def word_forms(counts: DataFrame, ratio: int = 10, least: int = 5) -> DataFrame:
    """word, form, support: rare words and the frequent words they could stand for, with the neighbours both have."""
    pairs = counts.where("kind = 'words'").select(F.col("a").alias("left"), F.col("b").alias("word"), "n")
    words = pairs.where("word <> '#'").groupBy("word").agg(F.sum("n").alias("n"))
    strokes = F.pandas_udf(lambda s: s.map(skeleton), "string")
    # only words that share a skeleton meet; a group is bounded by the spellings of one skeleton
    grouped = kept(words.where(F.length("word") >= least - 2).withColumn("strokes", strokes("word")))
    forms = grouped.where(f"length(word) >= {least} and word rlike '^\\\\p{{L}}+$'").select("strokes", F.col("word").alias("form"), F.col("n").alias("often"))
    rare = grouped.join(forms, "strokes").where(f"word <> form and often >= {ratio} * n").select("word", "form")
    letters = lambda w: F.array_sort(F.split(w, ""))
    rare = rare.where(letters(F.col("word")) != letters(F.col("form")))  # letters in another order are a typing error
    halves = pairs.where("left <> '#'").select("word", F.concat("left", "word").alias("both")).join(words.where("n >= 3").select(F.col("word").alias("both")), "both", "left_semi")
    rare = sized(rare.join(halves.select("word").distinct(), "word", "left_anti"))  # less the rest of a word that was cut
    before = pairs.where("left <> '#'").select(F.col("word").alias("w"), F.concat(F.lit("<"), "left").alias("context"), "n")
    after = pairs.where("word <> '#' and left <> '#'").select(F.col("left").alias("w"), F.concat(F.lit(">"), "word").alias("context"), "n")
    contexts = before.unionByName(after)
    # both sides, and the neighbour may be damaged itself, hence any one of them
    of_rare = sized(contexts.join(rare, contexts["w"] == rare["word"]).select("word", "form", "context"))
    both = contexts.withColumnRenamed("w", "form").join(of_rare, ["form", "context"])
    return both.groupBy("word", "form").agg(F.sum("n").cast("double").alias("support"))


def known_words(counts: DataFrame, least: int = 3) -> DataFrame:
    """word, n: words of letters seen ``least`` times or more."""
    words = counts.where("kind = 'words' and b <> '#'").groupBy(F.col("b").alias("word")).agg(F.sum("n").alias("n"))
    return words.where(f"n >= {least} and word rlike '^\\\\p{{L}}{{4,}}$'")


def han_forms(counts: DataFrame, ratio: float = 25.0) -> DataFrame:
    """trigram, form, support: trigrams whose middle is taken for a look-alike that forms frequent pairs with both neighbours."""
    tri = kept(counts.where("kind = 'han'").select(F.col("a").alias("trigram"), "n"))
    left = tri.groupBy(F.substring("trigram", 1, 2).alias("pair")).agg(F.sum("n").alias("n"))
    right = tri.groupBy(F.substring("trigram", 2, 2).alias("pair")).agg(F.sum("n").alias("n"))
    alike = tri.sparkSession.createDataFrame([(c, o) for c, others in _HAN_OF.items() for o in others], "c string, o string")
    each = tri.withColumn("c", F.substring("trigram", 2, 1)).join(F.broadcast(alike), "c")  # the table of look-alikes above
    each = each.withColumn("l", F.substring("trigram", 1, 1)).withColumn("r", F.substring("trigram", 3, 1))
    for name, a, b, counted in (("l1", "l", "c", left), ("l2", "l", "o", left), ("r1", "c", "r", right), ("r2", "o", "r", right)):
        each = each.withColumn("pair", F.concat(a, b)).join(counted.withColumnRenamed("n", name), "pair", "left").fillna(0, [name]).drop("pair")
    # at the edge of a Han run only the other side says something
    for side, edge in (("l", F.col("l") == "#"), ("r", F.col("r") == "#")):
        for name in (f"{side}1", f"{side}2"):
            each = each.withColumn(name, F.when(edge, 1).otherwise(F.col(name)))
    sure = (F.col("l2") * F.col("r2") >= ratio * F.col("l1") * F.col("r1")) & (F.col("l2") >= F.col("l1")) & (F.col("r2") >= F.col("r1"))
    known_sides = F.when(F.col("l") != "#", 1).otherwise(0) + F.when(F.col("r") != "#", 1).otherwise(0)
    return each.where(sure & (known_sides > 0) & (F.col("l2") + F.col("r2") >= 6)).select("trigram", F.col("o").alias("form"), (F.col("l2").cast("double") * F.col("r2")).alias("support"))


def candidates(df: DataFrame, key: str, source: str, title: str, page: str, text: str) -> DataFrame:
    """item_id, line_no, noise, key of what could be noise in (scanned) rows; key null where it is noise already."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masked = _Masked()
        titles: dict[tuple[str | None, str], set[str]] = {}
        for batch in batches:
            rows: list[tuple] = []
            titles.clear()
            for item, origin, name, number, content in zip(*(batch.column(i).to_pylist() for i in range(5))):
                found: set[tuple] = set()
                if (name, origin) not in titles:
                    titles[name, origin] = {v for shape in title_shapes(name, origin) for v in one_off(shape, glyphs=True)}
                titled = titles[name, origin]
                lines = content.split("\n")
                edges = edges_of(lines)
                starts = [_GOES_ON.match(line) for line in lines]
                carried: set[int] = set()  # lines that may begin with the rest of a word
                sure: set[int] = set()
                for i, line in enumerate(lines):
                    if is_page_line(line, number):
                        sure.add(i)
                    elif len(line) <= 2 * LONGEST and (shape := line_shape(line, i in edges)) is not None:
                        if any(v in titled for v in one_off(shape[0])):
                            sure.add(i)
                        else:
                            for v in one_off(shape[1]):
                                found.add((i, "page_furniture", f"\0{v}"))
                                found.add((i, "page_furniture", f"\0{v}\0{origin}"))
                found.update((i, "page_furniture", None) for i in sure)
                for i, line in enumerate(lines):
                    if m := _BROKEN.search(line):
                        for j in range(i + 1, min(i + 1 + REACH, len(lines))):
                            if not starts[j]:
                                continue
                            if all(k in sure or not lines[k].strip() for k in range(i + 1, j)):
                                carried.add(j)
                            whole = (m[1] + starts[j][1]).lower()
                            found.add((i, "broken_word", whole))
                            found.add((i, "misread", whole))
                            found.add((i, "broken_word", skeleton(whole)))
                    rest = line[: m.start()] if m else line
                    rest = rest[starts[i].end() :] if i in carried else rest
                    for w in _WORD.findall(_spelled(rest)):
                        if len(w) >= 3 and (shown := masked[w]) != "#":
                            found.add((i, "misread", shown))
                if not content.isascii():
                    squeezed, of = _joined_lines(lines)
                    context = _han_context(squeezed)
                    for m in _HAN_PLACE.finditer(context):
                        at = m.start()
                        found.add((of[at], "misread", context[at : at + 3]))
                rows += [(item, *f) for f in found]
            columns = list(zip(*rows)) or [(), (), (), ()]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["item_id", "line_no", "noise", "key"])

    picked = df.select(F.col(key).cast("string").alias("i"), F.col(source).alias("s"), F.col(title).alias("n"), F.col(page).cast("int").alias("p"), F.col(text).alias("t"))
    picked = picked.where("i is not null and s is not null and t is not null and t <> ''")
    return picked.mapInArrow(look, "item_id string, line_no int, noise string, key string")


class ScanNoise:
    """The corpus' statistics and what they say about its scanned rows."""

    def __init__(self, df: DataFrame, key: str, source: str, title: str, page: str, text: str) -> None:
        self.df, self.columns = df, (key, source, title, page, text)
        counts = kept(corpus_counts(df, key, source, page, text))
        surely = sized(scanned_sources(counts))
        templates = sized(furniture_templates(counts, surely))
        self.scanned = sized(with_furniture(surely, counts, templates))
        self.words, self.han = word_forms(counts), han_forms(counts)
        known = kept(known_words(counts))
        strokes = F.pandas_udf(lambda s: s.map(skeleton), "string")
        row = lambda noise, key, form, support: (F.lit(noise).alias("noise"), key.alias("key"), form.alias("form"), support.cast("double").alias("support"))
        accepted = [
            furniture_keys(templates).select(*row("page_furniture", F.col("key"), F.lit(None).cast("string"), F.lit(0))),
            self.words.select(*row("misread", F.col("word"), F.col("form"), F.col("support"))),
            self.han.select(*row("misread", F.col("trigram"), F.col("form"), F.col("support"))),
            known.select(*row("broken_word", F.col("word"), F.col("word"), F.lit(float("inf")))),
            known.where("length(word) >= 5").select(*row("broken_word", strokes("word"), F.col("word"), F.col("n"))),
        ]
        first, *rest = accepted
        for more in rest:
            first = first.unionByName(more)
        self.accepted = sized(first.groupBy("noise", "key").agg(F.max_by("form", F.struct("support", "form")).alias("form")))

    def found(self) -> DataFrame:
        """item_id, line_no, noise, key, form of all noise; furniture is nothing else."""
        key, source, title, page, text = self.columns
        scans = self.df.join(self.scanned, F.col(source) == self.scanned["source"], "left_semi")
        could_be = kept(candidates(scans, key, source, title, page, text))
        sure = could_be.where("key is null").withColumn("form", F.lit(None).cast("string"))
        rest = could_be.where("key is not null").join(self.accepted, ["noise", "key"])
        noise = sure.select("item_id", "line_no", "noise", "key", "form").unionByName(rest.select("item_id", "line_no", "noise", "key", "form"))
        whole_line = Window.partitionBy("item_id", "line_no")
        marked = noise.withColumn("furniture", F.max(F.when(F.col("noise") == "page_furniture", 1).otherwise(0)).over(whole_line))
        return marked.where("furniture = 0 or noise = 'page_furniture'").drop("furniture").distinct()

    def repaired(self, to: str) -> DataFrame:
        """``df`` with the repaired text in the new column ``to``; texts of other sources are as they were.

        Furniture is left out, misread words get the form they stand for, a
        broken word is put together at the end of its first line, and the lines
        of a paragraph (between blank lines) are one line.
        """
        key, source, _, _, text = self.columns
        item = F.col(key).cast("string").alias("item_id")
        own = self.df.join(self.scanned, F.col(source) == self.scanned["source"], "left_semi").where(F.col(text).isNotNull()).select(item, F.col(text).alias("t")).distinct()
        lines = own.select("item_id", F.xxhash64("t").alias("h"), F.posexplode(F.split("t", "\n", -1)).alias("line_no", "line"))
        misread = (F.col("noise") == "misread") & F.col("form").isNotNull()
        noise = self.found().groupBy("item_id", "line_no").agg(
            F.max((F.col("noise") == "page_furniture").cast("int")).alias("furniture"), F.min(F.when(F.col("noise") == "broken_word", F.col("form"))).alias("whole"),
            F.collect_list(F.when(misread, F.struct("key", "form"))).alias("forms"),
        )
        read = Window.partitionBy("item_id", "h").orderBy("line_no")
        kept = lines.join(noise, ["item_id", "line_no"], "left").where("coalesce(furniture, 0) = 0")
        blank = F.rlike("line", F.lit(r"(?U)^\s*$"))
        filled = kept.withColumn("paragraph", F.sum(blank.cast("int")).over(read)).where(~blank)
        near = filled.withColumn("before", F.lag("line").over(read)).withColumn("after", F.lead("line").over(read)).withColumn("carried", F.lag("whole").over(read))
        forms = F.transform(F.coalesce("forms", F.array().cast("array<struct<key:string,form:string>>")), lambda x: F.concat(x["key"], F.lit("\t"), x["form"]))
        fix = F.pandas_udf(_repaired_lines, "string")
        fixed = near.withColumn("line", fix("line", "before", "after", "carried", "whole", forms))
        first = F.row_number().over(Window.partitionBy("item_id", "h", "paragraph").orderBy("line_no")) == 1
        lead = F.when(F.row_number().over(read) == 1, "").when(first, "\n\n").when(F.rlike("line", F.lit(r"^[\p{P}]")) & F.col("carried").isNotNull(), "")
        lead = lead.when(F.rlike("before", F.lit(r"[\p{IsHan}。，、；：！？）」』]\s*$")) & F.rlike("line", F.lit(r"^\s*[\p{IsHan}。，、；：！？（「『]")), "").otherwise(" ")
        parts = fixed.withColumn("part", F.concat(lead, F.trim("line"))).groupBy("item_id", "h").agg(F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "part")))["part"], "").alias("__text"))
        back = own.select("item_id", F.xxhash64("t").alias("h")).join(parts, ["item_id", "h"], "left").select(F.col("item_id").alias("__item"), F.col("h").alias("__h"), F.coalesce("__text", F.lit("")).alias("__text"))
        joined = self.df.join(back, (F.col(key).cast("string") == F.col("__item")) & (F.xxhash64(text) == F.col("__h")), "left")
        return joined.withColumn(to, F.coalesce("__text", F.col(text))).drop("__item", "__h", "__text")


def _cased(form: str, like: str) -> str:
    return form.capitalize() if like[:1].isupper() and like[1:2].islower() else form.upper() if like.isupper() and len(like) > 1 else form


def _repaired_line(line: str, before: str, after: str, carried: str | None, whole: str | None, forms: list[str]) -> str:
    known = dict(f.split("\t", 1) for f in forms if f)
    squeezed, at = "", []
    for i, c in enumerate(line):
        if not c.isspace():
            squeezed += c
            at.append(i)
    context = _han_context("".join(before.split())[-1:] + squeezed + "".join(after.split())[:1])
    shift = 1 - bool(before.strip())
    letters = list(line)
    for i in range(len(squeezed)):
        if (form := known.get(context[i + 1 - shift : i + 4 - shift])) is not None and len(form) == 1:
            letters[at[i]] = form
    out = "".join(letters)
    if carried is not None and (m := _GOES_ON.match(out)):
        out = out[m.end() :]
    tail = ""
    if whole is not None and (m := _BROKEN.search(out)):
        out, tail = out[: m.start()], _cased(whole, m[1])
    return _WORD.sub(lambda m: _cased(known[m[0].lower()], m[0]) if m[0].lower() in known else m[0], out) + tail


def _repaired_lines(line: pd.Series, before: pd.Series, after: pd.Series, carried: pd.Series, whole: pd.Series, forms: pd.Series) -> pd.Series:
    rows = zip(line, before, after, carried, whole, forms)
    return pd.Series([_repaired_line(a, b or "", c or "", d, e, list(f)) for a, b, c, d, e, f in rows], dtype=object)
