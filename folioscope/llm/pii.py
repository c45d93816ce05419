"""Personal data by patterns and by what terms disclose. DataFrame functions only.

Base: e-mail addresses, IP addresses, card numbers and phone numbers, leftmost and non-overlapping per kind. The regular
expressions are written so that no text makes them quadratic: a start is tried only where a run begins or the last
match ended.

Method: protected entities are the values found and, so that a person's addresses at several hosts count together, the
letters of an e-mail address before the @. The whole words within ``reach`` characters of an entity are terms that may
disclose it, and so are the words of an address that stand anywhere else in its text. Over the whole corpus, with N
rows, p(e) = rows that hold e / N and p(e|t) = rows that hold t with e / rows that hold t, a term discloses the share
1 + log p(e|t) / -log p(e) of e's information (its pointwise mutual information with e over e's own). A term that
discloses ``share`` or more of an entity and goes with it in ``least`` different texts, or in one text if it is a word of
the entity itself, is a span of kind "term" wherever it stands. Sanitising puts the kind's name for base spans
(generalised) and "[TERM]" for terms.

Defined results: null text is empty; a null id is an id like any other; repeated rows give repeated rows, count as rows
in the probabilities and as one text in the support; texts of any length are read whole, in linear time; a term that
reaches ``share`` exactly is disclosing (ties need no order); an entity that is in every row has no information to
disclose; an empty table gives an empty result; columns of docs may have any name. Spans are in code points, end
exclusive; a term that overlaps a base span is left to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"[A-Za-z0-9._%+-]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a maximal run of single digits parted by at most one blank or hyphen, if it has 16 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_CHEAP = {"email": "contains({}, '@')", "ip": r"rlike({}, r'[0-9]\.[0-9]')", "card": "rlike({}, '[0-9]{{2}}|[0-9][ -][0-9]')", "phone": "contains({}, '+')"}
_WORD = r"[\p{L}\p{N}]"
#: A word that may disclose something.
TERM = rf"{_WORD}{{2,}}+"
_SPAN = "array<struct<kind:string,start:int,end:int>>"


#: Expressions are written as SQL: built call by call they take seconds of the driver.
_VALID = {
    "email": "true",
    "ip": rf"rlike(x.value, r'^{_OCTET}(?:\.{_OCTET}){{3}}$')",
    "card": "aggregate(transform(filter(split(reverse(regexp_replace(x.value, '[^0-9]', '')), ''), c -> c <> ''), (c, i) -> int(c) * (1 + i % 2) - if(i % 2 = 1 and c > '4', 9, 0)), 0, (s, y) -> s + y) % 10 = 0",
    "phone": "length(regexp_replace(x.value, '[^0-9]', '')) between 8 and 15",
}
_TYPED = "array<struct<kind:string,start:int,end:int,value:string>>"


def _bound(value: str, name: str, body: str) -> str:
    """body with value evaluated once, as name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _scan(numbers: str, join) -> str:
    """Running join (n-ary sum or maximum) over an array: linear passes, each reaching eight times as far; 10 reach any array that a text can fill."""
    for k in range(10):
        a, w = f"a{k}", 1 << 3 * k
        more = join(*[f"get({a}, i - {j * w})" for j in range(1, 8)])
        numbers = _bound(numbers, a, f"case when size({a}) <= {w} then {a} else transform({a}, (x, i) -> {more}) end")
    return numbers


def _sum(*more: str) -> str:
    return " + ".join(["x", *[f"coalesce({y}, 0)" for y in more]])


def _most(*more: str) -> str:
    return f"greatest(x, {', '.join(more)})"


def matches(text: str, pattern: str) -> str:
    """array<struct<value, start, end>> of the leftmost non-overlapping matches in a column; code points, end exclusive."""
    zipped = f"zip_with(split({text}, r'{pattern}', -1), regexp_extract_all({text}, r'{pattern}', 0), (g, v) -> named_struct('gap', length(g), 'value', v))"
    steps = "transform(p, (x, i) -> x.gap + if(i > 0, length(get(p, i - 1).value), 0))"
    spans = f"zip_with(p, {_scan(steps, _sum)}, (x, s) -> named_struct('value', x.value, 'start', s, 'end', s + length(x.value)))"
    return _bound(zipped, "p", f"filter({spans}, x -> x.value is not null)")


def base_spans(text: str) -> F.Column:
    """array<struct<kind, start, end, value>> of the base kinds in a column, by kind, then start."""
    found = []
    for kind in KINDS:
        spans = f"transform(filter({matches(text, PATTERNS[kind])}, x -> {_VALID[kind]}), x -> named_struct('kind', '{kind}', 'start', x.start, 'end', x.end, 'value', x.value))"
        found.append(f"case when {_CHEAP[kind].format(text)} then {spans} else cast(array() as {_TYPED}) end")
    return F.expr(f"concat({', '.join(found)})")


def _terms(text: F.Column) -> F.Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda w: F.lower(w)))


def _text(docs: DataFrame) -> F.Column:
    return F.coalesce(docs["text"], F.lit(""))


def _key(text: F.Column) -> F.Column:
    return F.unhex(F.sha2(text, 256))


def _windows(text: F.Column, span: F.Column, reach: int) -> F.Column:
    """The whole words within reach characters of a span, its own and those that it or the reach cuts left out."""
    low = F.greatest(span["start"] - reach, F.lit(0))
    before = F.regexp_replace(F.substring(text, low + 1, span["start"] - low), rf"{_WORD}++$", "")
    before = F.when(low > 0, F.regexp_replace(before, rf"^{_WORD}++", "")).otherwise(before)
    after = F.regexp_replace(F.substring(text, span["end"] + 1, reach), rf"^{_WORD}++", "")
    after = F.when(span["end"] + reach < F.length(text), F.regexp_replace(after, rf"{_WORD}++$", "")).otherwise(after)
    return _terms(F.concat_ws("\n", before, after))


def _own_words(value: F.Column) -> F.Column:
    """The words of an address before its @, without numbers."""
    return F.filter(_terms(F.substring_index(value, "@", 1)), lambda w: ~w.rlike("^[0-9]+$"))


def _pooled(value: F.Column) -> F.Column:
    """What an address shares with others of its owner."""
    return F.regexp_replace(F.lower(F.substring_index(value, "@", 1)), "[^a-z]+", "")


def pairs(docs: DataFrame, reach: int) -> DataFrame:
    """(key, rows, entity, term, own): each text's entities with the terms that go with them; term is null once an entity."""
    text = _text(docs)
    some = F.lit(False)
    for kind in KINDS:
        some = some | (F.expr(_CHEAP[kind].format("text")) & F.col("text").rlike(PATTERNS[kind]))
    # copies of a text meet as one row a task
    held = docs.select(text.alias("text")).where(some).groupBy(_key(F.col("text")).alias("key")).agg(F.first("text").alias("text"), F.count("*").alias("rows"))
    free = _terms(F.regexp_replace("text", PATTERNS["email"], "\n"))
    each = held.select("key", "rows", "text", F.when(F.col("text").contains("@"), free).alias("free"), F.explode(base_spans("text")).alias("b"))
    mail = F.col("b.kind") == "email"
    value = F.concat_ws(":", "b.kind", F.lower("b.value"))
    names = F.when(mail & (F.length(_pooled(F.col("b.value"))) > 1), F.array(value, F.concat(F.lit("mailbox:"), _pooled(F.col("b.value"))))).otherwise(F.array(value))
    near = F.transform(_windows(F.col("text"), F.col("b"), reach), lambda w: F.struct(w.alias("term"), F.lit(False).alias("own")))
    own = F.transform(F.array_intersect("free", _own_words(F.col("b.value"))), lambda w: F.struct(w.alias("term"), F.lit(True).alias("own")))
    none = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(False).alias("own")))
    all_ = F.concat(none, near, F.when(mail, own).otherwise(F.array().cast("array<struct<term:string,own:boolean>>")))
    return each.select("key", "rows", names.alias("names"), F.explode(all_).alias("t")).select("key", "rows", F.explode("names").alias("entity"), "t.term", "t.own")


def disclosing(docs: DataFrame, reach: int = 256, share: float = 0.9, least: int = 2) -> DataFrame:
    """(term, entity, share) of each term that discloses share or more of an entity."""
    once = stored(pairs(docs, reach).groupBy("key", "entity", "term").agg(F.max("rows").alias("rows"), F.max("own").alias("own")))
    entities = once.where("term is null").groupBy("entity").agg(F.sum("rows").alias("e"))
    both = once.where("term is not null").groupBy("entity", "term").agg(F.count("*").alias("texts"), F.sum("rows").alias("both"), F.max("own").alias("own"))
    n = docs.count()
    likely = stored(both.where((F.col("texts") >= least) | F.col("own")).join(entities, "entity").where(F.col("e") < n))
    sizes = docs.select(F.explode(_terms(_text(docs))).alias("term")).groupBy("term").agg(F.count("*").alias("t"))
    found = likely.join(sizes, "term").withColumn("share", 1 + F.log(F.col("both") / F.col("t")) / F.log(F.lit(float(n)) / F.col("e")))
    return stored(found.where(F.col("share") >= share - 1e-12).select("term", "entity", "share"))


def _risky(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(key, risky): the disclosing terms of each text that has some; a text's own words at most."""
    text = _text(docs)
    words = docs.select(_key(text).alias("key"), F.explode(_terms(text)).alias("term"))
    return stored(words.join(found.select("term").distinct(), "term").groupBy("key").agg(F.collect_set("term").alias("risky")))


def annotated(docs: DataFrame, reach: int = 256, share: float = 0.9, least: int = 2) -> DataFrame:
    """(row, text, base, spans): each row of docs as a struct, its text ("" for null), its base spans and all spans."""
    lists = _risky(docs, disclosing(docs, reach, share, least))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), _text(docs).alias("text")).withColumn("key", _key(F.col("text")))
    joined = rows.join(lists, "key", "left").withColumn("base", F.transform(base_spans("text"), lambda x: F.struct(x["kind"], x["start"], x["end"])))
    found = F.expr(f"filter({matches('text', TERM)}, x -> array_contains(risky, lower(x.value)))")
    free = F.filter(found, lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    terms = F.transform(free, lambda x: F.struct(F.lit("term").alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return joined.select("row", "text", "base", F.when(F.col("risky").isNull(), F.col("base")).otherwise(F.concat(F.col("base"), terms)).cast(_SPAN).alias("spans"))


def find(docs: DataFrame, reach: int = 256, share: float = 0.9, least: int = 2) -> DataFrame:
    """doc_id, text, base and all spans (array<struct<kind, start, end>>) of each row."""
    return annotated(docs, reach, share, least).select(F.col("row.doc_id").cast("long").alias("doc_id"), "text", "base", "spans")


def joined(spans: str) -> F.Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _sanitised(text: str, spans: str) -> F.Column:
    """text with each span, or chain of overlapping spans, replaced by the kind of its first."""
    part = f"if(x.start >= if(i > 0, get(e, i - 1), 0), concat(substring({text}, if(i > 0, get(e, i - 1), 0) + 1, x.start - if(i > 0, get(e, i - 1), 0)), '[', upper(x.kind), ']'), '')"
    pieces = f"concat(array_join(transform(s, (x, i) -> {part}), ''), substring({text}, element_at(e, -1) + 1, length({text})))"
    body = _bound(_scan("transform(s, x -> x.end)", _most), "e", pieces)
    sorted_ = f"array_sort(transform({spans}, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind)))"
    return F.expr(f"case when size({spans}) > 0 then {_bound(sorted_, 's', body)} else {text} end")


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with texts cleaned of all spans; n_chars, where there is one, follows. Null texts stay null."""
    out = annotated(docs)
    some = F.size("spans") > 0
    new = {"text": F.when(some, _sanitised("text", "spans")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(some, F.length(new["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
