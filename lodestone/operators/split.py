"""One text to many pieces: paragraphs, chunks, passages, evidence blocks, quiz questions.

Sequential rules are folds (``aggregate``) over arrays of small structs; texts are cut out
afterwards, so an accumulator never carries them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.text import SENTENCE_END, WS, let, strip, sub
from lodestone.functions.tokens import terms_text

PARAGRAPH_TAGS = ("p", "li", "blockquote", "pre", "code", "td", "th")
HEADING_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def _pieces(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern), strip), lambda p: p != "")


def paragraph_texts(clean: Column) -> Column:
    """Blank-line paragraphs, else lines, else (over 900 characters) sentences of a cleaned text."""
    by_line = let(lambda lines: F.when((F.size(lines) <= 1) & (F.length(clean) > 900), _pieces(clean, SENTENCE_END)).otherwise(lines), _pieces(clean, r"\n+"))
    step = let(lambda blank: F.when(F.size(blank) > 1, blank).otherwise(by_line), _pieces(clean, rf"\n{WS}*\n+"))
    return F.when(clean == "", F.expr("cast(array() as array<string>)")).otherwise(step)


def paragraphs(text: Column, entities: bool = True) -> Column:
    """array<struct<paragraph_index, text, char_start, char_end, page_number>>; spans index the cleaned text."""
    return let(_placed, X.clean_kb(text, entities))


def _placed(clean: Column) -> Column:
    parts = F.filter(F.transform(paragraph_texts(clean), lambda p: X.clean_kb(p, False)), lambda p: p != "")
    return let(lambda parts: _spans(clean, parts), parts)


def _spans(clean: Column, parts: Column) -> Column:
    start = F.struct(F.lit(0).alias("cursor"), F.expr("cast(array() as array<struct<a:int,b:int>>)").alias("spans"))

    def place(acc: Column, p: Column) -> Column:
        at = F.call_function("locate", p, clean, acc["cursor"] + 1)
        a = F.when(at > 0, at - 1).otherwise(acc["cursor"])
        b = a + F.length(p)
        return F.struct(b.alias("cursor"), F.concat(acc["spans"], F.array(F.struct(a.alias("a"), b.alias("b")))).alias("spans"))

    spans = F.aggregate(parts, start, place, lambda acc: acc["spans"])
    return F.transform(F.arrays_zip(parts.alias("p"), spans.alias("s")), lambda x, i: F.struct(
        (i + 1).cast("int").alias("paragraph_index"), x["p"].alias("text"), x["s"]["a"].alias("char_start"), x["s"]["b"].alias("char_end"), X.pdf_page_number(x["p"]).alias("page_number")))


def chunks(paras: Column, size: int = 1000, overlap: int = 160) -> Column:
    """array<struct<chunk_index, text, paragraph_start, paragraph_end, char_start, char_end>>.

    Paragraphs are joined while they fit; one longer than 1.5 times ``size`` is sliced with an overlap.
    """
    return let(lambda p: _packed(p, size, overlap), paras)


def _packed(paras: Column, size: int, overlap: int) -> Column:
    step = max(1, size - overlap)
    made = "cast(array() as array<struct<a:int,b:int,at:int>>)"
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.expr(made).alias("out"))

    def flushed(acc: Column) -> Column:
        return F.when(acc["n"] > 0, F.concat(acc["out"], F.array(F.struct(acc["a"].alias("a"), acc["b"].alias("b"), F.lit(-1).alias("at"))))).otherwise(acc["out"])

    def take(acc: Column, p: Column) -> Column:
        return let(lambda n, i: grown(acc, n, i), F.length(p["text"]), p["paragraph_index"])

    def grown(acc: Column, n: Column, i: Column) -> Column:
        slices = F.transform(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda at: F.struct(i.alias("a"), i.alias("b"), at.alias("at")))
        long = F.struct(F.lit(0).alias("n"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.concat(flushed(acc), slices).alias("out"))
        more = F.struct((acc["n"] + n + 2).alias("n"), acc["a"].alias("a"), i.alias("b"), acc["out"].alias("out"))
        new = F.struct(n.alias("n"), i.alias("a"), i.alias("b"), flushed(acc).alias("out"))
        return F.when(n > int(size * 1.5), long).when((acc["n"] > 0) & (acc["n"] + n + 2 <= size), more).otherwise(new)

    plan = F.aggregate(paras, start, take, flushed)

    def build(c: Column) -> Column:
        return let(lambda first, last: cut_out(c, first, last), F.element_at(paras, c["a"]), F.element_at(paras, c["b"]))

    def cut_out(c: Column, first: Column, last: Column) -> Column:
        joined = F.array_join(F.transform(F.slice(paras, c["a"], c["b"] - c["a"] + 1), lambda p: p["text"]), "\n\n")
        at = first["char_start"] + c["at"]
        whole = F.struct(X.clean_kb(joined, False).alias("text"), c["a"].alias("paragraph_start"), c["b"].alias("paragraph_end"), first["char_start"].alias("char_start"), last["char_end"].alias("char_end"), F.lit(40).alias("least"))
        part = let(lambda cut: F.struct(cut.alias("text"), c["a"].alias("paragraph_start"), c["b"].alias("paragraph_end"), at.alias("char_start"), (at + F.length(cut)).alias("char_end"), F.lit(80).alias("least")), strip(F.substr(first["text"], c["at"] + 1, F.lit(size))))
        return F.when(c["at"] < 0, whole).otherwise(part)

    kept = F.filter(F.transform(plan, build), lambda c: F.length(c["text"]) >= c["least"])
    return F.transform(kept, lambda c, i: F.struct(i.cast("int").alias("chunk_index"), c["text"].alias("text"), c["paragraph_start"].alias("paragraph_start"), c["paragraph_end"].alias("paragraph_end"), c["char_start"].alias("char_start"), c["char_end"].alias("char_end")))


def passages(text: Column) -> Column:
    """Sentences of 40 to 900 characters; longer ones as overlapping slices of their first 2600."""
    parts = F.transform(F.split(X.one_spaced(X.filled(text)), SENTENCE_END), X.clean_snippet)

    def of(part: Column) -> Column:
        n = F.length(part)
        slices = F.transform(F.sequence(F.lit(0), F.least(n, F.lit(2600)) - 1, F.lit(520)), lambda at: X.clean_snippet(F.substr(part, at + 1, F.lit(620))))
        kept = F.filter(slices, lambda s: F.length(s) >= 40)
        return F.when(n.between(40, 900), F.array(part)).when(n > 900, kept).otherwise(F.expr("cast(array() as array<string>)"))

    return F.flatten(F.transform(parts, of))


def long_parts(text: Column, max_len: int = 700, entities: bool = False) -> Column:
    """Sentences packed up to max_len; a longer sentence is cut hard."""
    return let(lambda clean: _packed_sentences(clean, max_len), X.clean_web(text, entities=entities))


def _packed_sentences(clean: Column, max_len: int) -> Column:
    none = F.expr("cast(array() as array<string>)")
    start = F.struct(F.lit("").alias("cur"), none.alias("out"))

    def flushed(acc: Column) -> Column:
        return F.when(acc["cur"] != "", F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"])

    def take(acc: Column, s: Column) -> Column:
        hard = F.filter(F.transform(F.sequence(F.lit(0), F.length(s) - 1, F.lit(max_len)), lambda at: strip(F.substr(s, at + 1, F.lit(max_len)))), lambda p: p != "")
        more = F.struct(strip(F.concat(acc["cur"], F.lit(" "), s)).alias("cur"), acc["out"].alias("out"))
        cut = F.struct(F.lit("").alias("cur"), F.concat(flushed(acc), hard).alias("out"))
        new = F.struct(s.alias("cur"), flushed(acc).alias("out"))
        return F.when(F.length(acc["cur"]) + F.length(s) + 1 <= max_len, more).when(F.length(s) > max_len, cut).otherwise(new)

    packed = F.aggregate(_pieces(clean, SENTENCE_END), start, take, flushed)
    return F.when(clean == "", none).when(F.length(clean) <= max_len, F.array(clean)).otherwise(packed)


def text_blocks(text: Column, entities: bool = True) -> Column:
    """Raw blocks, array<struct<tag, text>>, of a page's plain text."""
    rough = let(lambda clean: let(lambda lines: F.when(F.size(lines) > 1, lines).otherwise(F.split(clean, SENTENCE_END)), F.split(clean, r"\n+")), X.clean_web(text, entities=entities))
    parts = F.transform(rough, lambda p: X.clean_web(p, entities=False))
    none = F.expr("cast(array() as array<string>)")
    texts = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) > 900, long_parts(p, 650)).when(F.length(p) >= 20, F.array(p)).otherwise(none)))
    return F.transform(texts, lambda t: F.struct(F.lit("text").alias("tag"), t.alias("text")))


def normalize_blocks(raw: Column) -> Column:
    """Numbered blocks of a page from its raw ones: short ones and repeats go, first wins."""
    clean = F.filter(F.transform(raw, lambda b: F.struct(F.lower(F.coalesce(b["tag"], F.lit("text"))).alias("tag"), X.clean_web(b["text"], entities=False).alias("text"))), lambda b: F.length(b["text"]) >= 20)
    return let(_first_blocks, clean)


def _first_blocks(clean: Column) -> Column:
    keys = F.transform(clean, lambda b: F.lower(sub(F.substring(b["text"], 1, 220), f"{WS}+", " ")))
    first = let(lambda ks: F.filter(clean, lambda b, i: F.array_position(ks, F.element_at(ks, i + 1)) == i + 1), keys)
    return let(_numbered, first)


def _numbered(kept: Column) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("paras"), F.expr("cast(array() as array<struct<a:int,p:int>>)").alias("out"))

    def take(acc: Column, b: Column) -> Column:
        paras = acc["paras"] + F.when(b["tag"].isin(*PARAGRAPH_TAGS), 1).otherwise(0)
        mark = F.struct(acc["at"].alias("a"), F.when(b["tag"].isin(*PARAGRAPH_TAGS), paras).alias("p"))
        return F.struct((acc["at"] + F.length(b["text"]) + 1).alias("at"), paras.alias("paras"), F.concat(acc["out"], F.array(mark)).alias("out"))

    places = F.aggregate(kept, start, take, lambda acc: acc["out"])

    def named(x: Column, i: Column) -> Column:
        n = (i + 1).cast("int")
        where = F.when(x["m"]["p"].isNotNull(), F.concat(F.lit("网页正文第 "), x["m"]["p"].cast("string"), F.lit(" 段"))).when(x["b"]["tag"].isin(*HEADING_TAGS), F.concat(F.lit("网页正文标题块 "), n.cast("string"))).otherwise(F.concat(F.lit("网页正文块 "), n.cast("string")))
        return F.struct(F.concat(F.lit("P"), n.cast("string")).alias("block_id"), n.alias("block_index"), x["m"]["p"].alias("paragraph_index"), where.alias("location"), x["b"]["tag"].alias("tag"), x["b"]["text"].alias("text"), x["m"]["a"].alias("char_start"), (x["m"]["a"] + F.length(x["b"]["text"])).alias("char_end"))

    return F.transform(F.arrays_zip(kept.alias("b"), places.alias("m")), named)


QUESTION_START = rf"(?=\n?{WS}*\d+\.{WS}*[\(（]?(?:单选题|判断题|多选题)[\)）]?)"


def question_blocks(text: Column) -> Column:
    """Quiz questions of a text: it is split before each numbered one; else the whole text."""

    def of(clean: Column) -> Column:
        blocks = F.filter(F.transform(F.split(clean, QUESTION_START), X.clean_answer_block), lambda b: F.length(b) >= 20)
        found = let(lambda b: F.when(F.size(b) > 0, b).otherwise(F.array(clean)), blocks)
        return F.when(clean == "", F.expr("cast(array() as array<string>)")).otherwise(found)

    return let(of, X.clean_answer_block(text))


def options(block: Column) -> Column:
    """map letter -> text of a quiz question; a later one wins."""
    pattern = rf"(?i)(?:^|\n|{WS}|·){WS}*([A-H]){WS}*[.．、:：]{WS}*([^\n;；]+)"
    letters = F.transform(F.regexp_extract_all(block, F.lit(pattern), F.lit(1)), F.upper)
    values = F.transform(F.regexp_extract_all(block, F.lit(pattern), F.lit(2)), lambda v: strip(sub(X.clean_answer_block(v), rf"{WS}*我的答案.*$")))
    pairs = F.filter(F.arrays_zip(letters.alias("k"), values.alias("v")), lambda p: p["v"] != "")

    def last_wins(pairs: Column) -> Column:
        distinct = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
        last = F.transform(distinct, lambda k: F.element_at(F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"]), -1))
        return F.map_from_arrays(distinct, last)

    return let(last_wins, pairs)


def explode_paragraphs(docs: DataFrame, entities: bool = True) -> DataFrame:
    """A row for each paragraph of (doc_id, text)."""
    return docs.select("doc_id", F.inline(paragraphs(F.col("text"), entities)))


def explode_chunks(docs: DataFrame, size: int = 1000, overlap: int = 160, entities: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each chunk of (doc_id, text), with its terms and the document's columns ``keep``."""
    paras = docs.select("doc_id", *keep, paragraphs(F.col("text"), entities).alias("paras"))
    return paras.select("doc_id", *keep, F.inline(chunks(F.col("paras"), size, overlap))).withColumn("terms", terms_text(F.col("text")))
