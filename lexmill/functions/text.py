"""Cleaning and string expressions, Column to Column.

White space is Unicode's everywhere, lines end as Python's ``splitlines`` ends
them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values --------------------------------------------------------------
#: Left-over control tokens of recognition models.
CONTROL_TOKENS = ("<｜end▁of▁sentence｜>", "<|end_of_sentence|>", "<|Assistant|>", "<|User|>", "<PAGE>")
#: Beginnings of prompt lines that models repeat.
LEAK_PREFIXES = (
    "Do not use special characters",
    "Treat all tabular layout as plain text with spacing.",
    "Preserve the original document structure.",
    "Output section titles and headings using Markdown heading syntax",
    "Use Markdown headings only for visually distinct section titles",
    "Preserve tables, lists, and the original reading order.",
    "Do not summarize, rewrite, infer missing text",
)
#: Phrases a question loses before its words are looked for, in this order.
STOP_PHRASES = (
    "請問", "麻煩", "告訴我", "幫我查", "幫我找", "文件中", "表格中", "這份文件", "這份pdf", "這個pdf",
    "庫存量是多少", "庫存有多少", "數量是多少", "有多少", "是多少", "多少", "庫存量", "庫存", "數量",
    "規格是什麼", "規格", "編號是什麼", "編號", "哪一個", "哪個", "什麼", "為何", "如何", "怎麼",
    "嗎", "呢", "？", "?", "。", "，", ",", "：", ":",
)
#: Images in Markdown and what is read for them, tags, and runs of line breaks.
IMAGES = ((r"(?U)!\[\s*\]\([^)]+\)", "[圖片]"), (r"(?U)!\[\s*([^\]]*?)\s*\]\([^)]+\)", "[圖片：$1]"))
TAG, BLANK_LINES = (r"<[^>\n]+>", ""), (r"\n{3,}", "\n\n")
#: Marks of Markdown, in the order they are taken away.
MARKS = (
    (r"(?mU)^#{1,6}\s+", ""),
    (r"(?mU)^\s*[-*+]\s+", ""),
    (r"(?mU)^\s*\d+[.)]\s+", ""),
    (r"`{1,3}", ""),
    (r"\*\*(.*?)\*\*", "$1"),
    (r"__(.*?)__", "$1"),
    (r"(?<!\*)\*(?!\*)(.*?)\*(?!\*)", "$1"),
    (r"(?<!_)_(?!_)(.*?)_(?!_)", "$1"),
    (r"(?mU)^\s*\|?(?:\s*:?-{3,}:?\s*\|)+\s*:?-{3,}:?\s*\|?\s*$", ""),
)
#: Reasoning in generated texts: its marks, what is left of them, what stands before an answer.
THINK_OPEN, THINK_CLOSE = "<think>", "</think>"
OPENING, WHOLE, LEFT_OVER = r"(?is)^\s*<think>\s*", r"(?is)^\s*<think>.*?</think>\s*", r"(?is)^\s*(?:ot\s*)?</think>\s*"
UNTAGGED, FINAL = "thinking process:", ("\nFinal Answer:", "\nFinal answer:", "\n最終回答：", "\n正式回答：")
#: A table-of-contents line: title, leader, page.
TOC_LINE = r"^(.*?)(?:[.…·．]{2,}|\s+)\s*(\d{1,3})\s*$"
#: The heading of a procedure step; "1. ..." isn't one.
STEP_LINE = r"^\s*(\d{1,2})\s+[^.)、\s].*$"
# -------------------------------------------------------------------------------

LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
#: White space as Python's ``str`` methods have it (Unicode's, and the four separators of ASCII).
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = r"[\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def strip_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    """What stands between white space."""
    return F.filter(F.split(text, rf"{_SPACE}+"), lambda x: x != "")


def lines(text: Column) -> Column:
    """All lines; one empty element after a final line end is left out."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def filled_lines(text: Column) -> Column:
    """The stripped lines that aren't blank."""
    return F.filter(F.transform(lines(text), strip), lambda x: x != "")


def one_space(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(strip(text), rf"{_SPACE}+", " "))


def query_text(text: Column) -> Column:
    """A question in one line; an error if nothing is left."""
    short = one_space(text)
    return F.when(short != "", short).otherwise(F.raise_error(F.lit("the question is empty")).cast("string"))


def clean_markdown(text: Column) -> Column:
    """Recognised text without control tokens, line ends alike, no trailing blanks, at most one blank line."""
    out = F.regexp_replace(F.regexp_replace(text, "[﻿\\x00]", ""), r"\r\n?", "\n")
    for token in CONTROL_TOKENS:
        out = F.replace(out, F.lit(token), F.lit(""))
    out = F.array_join(F.transform(lines(out), strip_end), "\n")
    return strip(F.regexp_replace(F.regexp_replace(out, r"\n[ \t]+\n", "\n\n"), r"\n{3,}", "\n\n"))


def rag_markdown(text: Column, html_headings: bool = False) -> Column:
    """Markdown for retrieval: images as words, tags gone, optionally HTML headings kept as Markdown ones."""
    out = clean_markdown(text)
    if html_headings:
        for level in range(1, 7):
            out = F.regexp_replace(out, rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}>", "#" * level + " $1")
    return strip(_replaced(out, *IMAGES, TAG, BLANK_LINES))


def _replaced(text: Column, *rules: tuple[str, str]) -> Column:
    for pattern, to in rules:
        text = F.regexp_replace(text, pattern, to)
    return text


def plain_text(text: Column) -> Column:
    """Markdown without its marks."""
    return strip(_replaced(rag_markdown(text), *MARKS, BLANK_LINES))


def page_image_links(text: Column, page: Column) -> Column:
    """Links into a page's image folder, seen from the document."""
    folder = F.concat(F.lit("pages/page_"), F.lpad(page.cast("string"), 4, "0"), F.lit("/"))
    return F.regexp_replace(text, F.lit(r"!\[([^\]]*)\]\((images/[^)]+)\)"), F.concat(F.lit("![$1]("), folder, F.lit("$2)")))


def title_key(text: Column) -> Column:
    """What titles are compared by."""
    out = F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"(?U)^#{1,6}\s*", "")
    out = F.translate(F.regexp_replace(out, "[ 　]", ""), "（）：＂“”", '():"""')
    return F.regexp_replace(out, "[.…·．。]+$", "")


def without_leaks(text: Column) -> Column:
    """The text without repeated prompt lines."""
    kept = F.filter(lines(text), lambda x: ~_leaks(x))
    return strip(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def leaked_lines(text: Column) -> Column:
    return F.filter(lines(text), _leaks)


def _leaks(line: Column) -> Column:
    found = F.lit(False)
    for prefix in LEAK_PREFIXES:
        found = found | F.startswith(strip(line), F.lit(prefix))
    return found


def search_text(text: Column) -> Column:
    """Content as it is searched for words: lower case, quotes decoded."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "&quot;|&#34;", '"')


def search_key(question: Column) -> Column:
    """The question without its stop phrases."""
    out = F.lower(F.coalesce(question, F.lit("")))
    for phrase in STOP_PHRASES:
        out = F.replace(out, F.lit(phrase), F.lit(""))
    return search_text(out)


def word_score(key: Column, content: Column) -> Column:
    """1 if the content holds the key, 0.95 if it holds all its pieces, else 0."""
    text = search_text(content)
    pieces = F.filter(F.regexp_extract_all(key, F.lit(r"[a-z0-9.]+|[0-\\uf]{2,}"), F.lit(0)), lambda p: F.char_length(p) >= 2)
    all_held = (F.size(pieces) > 0) & F.forall(pieces, lambda p: F.contains(text, p))
    return F.when(F.char_length(key) < 2, 0.0).when(F.contains(text, key), 1.0).when(all_held, 0.95).otherwise(0.0)


def stem(name: Column) -> Column:
    """A file's name without its last suffix."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def passage_text(source_file: Column, title: Column, page: Column, content: Column) -> Column:
    """What is embedded for a chunk."""
    source = F.coalesce(F.nullif(source_file, F.lit("")), F.lit("未知文件"))
    head = F.concat(F.lit("passage: 文件名稱："), source)
    name = F.concat(F.lit("文件標題："), F.coalesce(F.nullif(title, F.lit("")), stem(source)))
    number = F.concat(F.lit("頁碼：第 "), page.cast("string"), F.lit(" 頁"))
    return F.concat_ws("\n", head, name, number, F.lit(""), strip(F.coalesce(content, F.lit(""))))


def summary_text(source_file: Column, title: Column, summary: Column) -> Column:
    """What is embedded for a document's summary (a struct); null for an empty one."""
    field = lambda name: F.nullif(strip(F.coalesce(summary[name], F.lit(""))), F.lit(""))
    labelled = lambda label, value: F.concat(F.lit(label), value)
    topics = F.nullif(F.array_join(F.filter(F.transform(F.coalesce(summary["topics"], F.array().cast("array<string>")), strip), lambda x: x != ""), "、"), F.lit(""))
    text, purpose = field("summary"), field("purpose")
    parts = (
        labelled("passage: 文件名稱：", source_file), labelled("文件標題：", F.coalesce(field("title"), F.nullif(strip(title), F.lit("")))), labelled("文件摘要：", text),
        labelled("文件目的：", purpose), labelled("主要主題：", topics), labelled("適用對象：", field("intended_audience")),
    )
    return F.when(text.isNotNull() | purpose.isNotNull() | topics.isNotNull(), F.concat_ws("\n", *parts))


def toc_entry(line: Column) -> Column:
    """title and page of a table-of-contents line; null for other lines."""
    text = strip(line)
    title = F.regexp_replace(F.regexp_extract(text, TOC_LINE, 1), r"^[ .…·．。\t]+|[ .…·．。\t]+$", "")
    return F.when(F.rlike(text, F.lit(TOC_LINE)) & (title != ""), F.struct(title.alias("title"), F.regexp_extract(text, TOC_LINE, 2).cast("int").alias("page")))


def step_number(line: Column) -> Column:
    """The number of a procedure step whose heading this line is, else null."""
    return F.when(F.rlike(line, F.lit(STEP_LINE)), F.regexp_extract(line, STEP_LINE, 1).cast("int"))


def heading_prefix(path: Column) -> Column:
    """A path of headings as Markdown, at most six levels deep."""
    return F.array_join(F.transform(path, lambda x, i: F.concat(F.repeat(F.lit("#"), F.least(i + 1, F.lit(6))), F.lit(" "), x)), "\n")


def json_array(text: Column, schema: str) -> Column:
    """The array in a model's answer: as it stands, or between the outermost brackets."""
    bare = _unfenced(text)
    inner = F.regexp_extract(bare, r"(?s)(\[.*\])", 1)
    return F.coalesce(F.from_json(bare, schema), F.from_json(F.nullif(inner, F.lit("")), schema))


def json_object(text: Column, schema: str) -> Column:
    """The object in a model's answer: fenced, or between the outermost braces."""
    inner = F.regexp_extract(_unfenced(text), r"(?s)(\{.*\})", 1)
    return F.from_json(F.nullif(inner, F.lit("")), schema)


def _unfenced(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")


def without_reasoning(text: Column) -> Column:
    """An earlier answer without its thinking part."""
    return strip(F.regexp_replace(strip(F.element_at(F.split(text, THINK_CLOSE, -1), -1)), WHOLE, ""))


def split_reasoning(text: Column, thinking: bool = False) -> Column:
    """reasoning and answer of a generated text: what stands before the first closing mark, and after it."""
    whole = strip(text)
    at = F.instr(whole, THINK_CLOSE)
    before, after = F.substr(whole, F.lit(1), at - 1), F.substr(whole, at + len(THINK_CLOSE))
    reasoning = F.when(at > 0, strip(F.regexp_replace(before, OPENING, ""))).otherwise("")
    answer = strip(_replaced(F.when(at > 0, after).otherwise(whole), (WHOLE, ""), (LEFT_OVER, "")))
    if not thinking:  # reasoning without marks: the answer is behind the last of the first final mark that is there
        finals = [F.when(F.contains(answer, F.lit(mark)), strip(F.element_at(F.split(answer, mark, -1), -1))) for mark in FINAL]
        answer = F.when(F.startswith(F.lower(answer), F.lit(UNTAGGED)), F.coalesce(*finals, answer)).otherwise(answer)
    return F.struct(reasoning.alias("reasoning"), answer.alias("answer"))


def score_text(score: Column) -> Column:
    """Four decimals, or a dash."""
    return F.coalesce(F.format_string("%.4f", score), F.lit("-"))
