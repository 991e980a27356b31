"""Fragments of the SQL counterparts, written for a second engine on its own terms.

Each function takes and gives SQL text.  Where an expression is used more than once it is
named in a CTE by the query, not repeated here.
"""

from __future__ import annotations

from lodestone.functions.text import HAN, WS
from lodestone.plans.inputs import DATED, HOSTS, NEGATIVE, PHRASES

NL = "chr(10)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str = "''") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {to}, 'g')"


def strip(x: str) -> str:
    return sub(x, f"^{WS}+|{WS}+$")


def one_spaced(x: str) -> str:
    return strip(sub(x, f"{WS}+", "' '"))


def filled(x: str) -> str:
    return f"coalesce({x}, '')"


def clean_kb(x: str) -> str:
    t = sub(sub(filled(x), r"[ \t\r\f\x0B]+", "' '"), r" *\n *", NL)
    return strip(sub(t, r"\n{3,}", f"{NL} || {NL}"))


def clean_web(x: str) -> str:
    return strip(sub(sub(filled(x), r"[ \t\r\f\x0B]+", "' '"), rf"\n{WS}*\n+", NL))


def snippet(x: str) -> str:
    t = sub(one_spaced(filled(x)), rf"(?i)\bMissing:{WS}*.*?(Show results with:|$)", r"'\1'")
    return one_spaced(sub(t, rf"(?i)\bShow results with:{WS}*[^{WS[1:-1]}]+"))


def answer_block(x: str) -> str:
    return strip(sub(sub(sub(filled(x), r"[\t\r\f\x0B]+", "' '"), rf"\n{WS}*\n+", NL), " {2,}", "' '"))


def cut(x: str, n: int, mark: str) -> str:
    return f"list_extract(list_transform([{x}], lambda t: CASE WHEN length(t) > {n} THEN {sub(f'substr(t, 1, {n})', WS + '+$')} || '{mark}' ELSE t END), 1)"


def sentences(x: str) -> str:
    return f"string_split({sub(x, f'([。！？!?.]){WS}+', chr(39) + chr(92) + '1' + chr(39) + ' || chr(1)')}, chr(1))"


def pieces(items: str) -> str:
    """Stripped, non-empty."""
    return f"list_filter(list_transform({items}, lambda p: {strip('p')}), lambda p: p <> '')"


def distinct(items: str) -> str:
    """First of each, in order; items is evaluated once."""
    return f"list_extract(list_transform([{items}], lambda l: list_filter(l, lambda x, i: list_position(l, x) = i)), 1)"


def grams(run: str, n: int) -> str:
    return f"list_transform(range(1, length({run}) - {n} + 2), lambda i: substr({run}, i, {n}))"


def kb_terms(x: str) -> str:
    low = f"lower({filled(x)})"
    latin = f"list_filter(list_transform(regexp_extract_all({low}, {q('[a-z0-9_][a-z0-9_.:/#-]{1,}')}), lambda t: {sub('t', '^[.:/#-]+|[.:/#-]+$')}), lambda t: length(t) >= 2)"
    han = f"flatten(list_transform(regexp_extract_all({low}, {q(HAN + '+')}), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE {grams('r', 1)} || {grams('r', 2)} || {grams('r', 3)} END))"
    return distinct(f"{latin} || {han}")


def listed(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def any_of(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def first_kind(x: str, table: dict, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(x, words)} THEN {q(kind)}" for kind, words in table.items()) + f" ELSE {q(default)} END"


def relevance_tokens(x: str, stop) -> str:
    low = f"lower({filled(x)})"
    latin = f"regexp_extract_all({low}, {q('[a-zA-Z0-9][a-zA-Z0-9_.+#/-]{1,}')})"
    run = f"(CASE WHEN length(r) BETWEEN 2 AND 6 THEN [r] ELSE [] END) || (CASE WHEN length(r) > 2 THEN {grams('r', 2)} || {grams('r', 3)} || {grams('r', 4)} ELSE [] END)"
    han = f"flatten(list_transform(regexp_extract_all({low}, {q(HAN + '+')}), lambda r: {run}))"
    return distinct(f"list_filter({latin} || {han}, lambda x: x NOT IN {listed(stop)})")


def lookup(x: str, table: dict, default) -> str:
    lit = lambda v: q(v) if isinstance(v, str) else str(v)
    return f"CASE {x} " + " ".join(f"WHEN {q(k)} THEN {lit(v)}" for k, v in table.items()) + f" ELSE {lit(default)} END"


def total(items: str, each: str) -> str:
    """Sum over items of an integer expression of x."""
    return f"coalesce(list_sum(list_transform({items}, lambda x: {each})), 0)"


def domain(url: str) -> str:
    found = f"regexp_extract({filled(url)}, {q('^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)')}, 1)"
    return sub(f"lower({found})", r"^www\.")


QUESTIONS = """SELECT conv_id AS qid, arg_min(text, (turn, text)) AS question FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY conv_id"""


def in_turn(number: str, values) -> str:
    return f"list_extract([{', '.join('NULL' if v is None else q(v) for v in values)}], CAST({number} % {len(values)} + 1 AS BIGINT))"


ASKED = f"""SELECT qid, CASE qid % 3 WHEN 0 THEN phrase WHEN 1 THEN question || ' ' || phrase ELSE question END AS question FROM (SELECT *, {in_turn('qid', PHRASES)} AS phrase FROM ({QUESTIONS}))"""
SEEN = f"""SELECT page_id, CASE WHEN host IS NULL THEN url ELSE regexp_replace(url, '^([A-Za-z]+)://[^/?#]*', '\\1://' || host) END AS url,
  CASE page_id % 5 WHEN 0 THEN {q(DATED)} || html WHEN 1 THEN {q(NEGATIVE)} || html ELSE html END AS html FROM (SELECT *, {in_turn('page_id', HOSTS)} AS host FROM pages)"""


def urls(x: str) -> str:
    mark = "[.,;:!?，。；：！？）)" + chr(92) + "]}>" + chr(39) + chr(34) + "]+$"
    found = f"regexp_extract_all({x}, {q('(?i)https?://[^' + WS[1:-1] + '<>' + chr(39) + chr(34) + '`]+')})"
    return distinct(f"list_filter(list_transform({found}, lambda u: {sub(strip('u'), mark)}), lambda u: u <> '')")


def domains(x: str) -> str:
    return distinct(f"list_filter(list_transform({urls(x)}, lambda u: {domain('u')}), lambda d: length(d) > 0)")


def say(template: str, *values: str) -> str:
    """A %s template as a concatenation."""
    parts = template.split("%s")
    out = [q(parts[0])]
    for value, part in zip(values, parts[1:]):
        out += [f"coalesce(CAST({value} AS VARCHAR), '')", q(part)]
    return "(" + " || ".join(out) + ")"


def first_spelling(items: str) -> str:
    """First of each spelling regardless of case."""
    return f"list_extract(list_transform([{items}], lambda l: list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i)), 1)"


def numbered(items: str) -> str:
    return f"array_to_string(list_transform({items}, lambda x, i: CAST(i AS VARCHAR) || '. ' || x), chr(10))"
