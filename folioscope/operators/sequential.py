"""Operators whose steps depend on the ones before: Arrow or pandas functions, per document or per row."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.alignment import distance, ratio


def _per_text(docs: DataFrame, column: str, function, name: str, kind: str) -> DataFrame:
    """doc_id and function(text) of each row, by Arrow batches."""
    types = {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}

    def run(batches):
        for batch in batches:
            found = [function(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, types[kind])], names=["doc_id", name])

    return docs.selectExpr("cast(doc_id as long) as doc_id", column).mapInArrow(run, f"doc_id long, {name} {kind}")


# ---- HTML


#: What a tag writes where it opens and where it closes.
_MARKS = {
    **{f"h{n}": ("\n\n" + "#" * n + " ", "\n\n") for n in range(1, 7)},
    **{tag: (mark, mark) for mark, tags in {"\n\n": "p", "**": "strong b", "*": "em i", "\n": "ul ol"}.items() for tag in tags.split()},
    "br": ("\n", ""),
}


def _grid(rows: list[list[str]]) -> str:
    drawn = ["| " + " | ".join(r) + " |" for r in rows]
    rule = ["| " + " | ".join(["---"] * len(rows[0])) + " |"] if len(rows) > 1 else []
    return "\n\n" + "\n".join(drawn[:1] + rule + drawn[1:]) + "\n\n" if rows else ""


class _Markdown(HTMLParser):
    """Most tags only write their marks; the others change a state, by (tag, whether it closes).

    Text goes to the innermost open block (cell or preformatted), else to the page.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[list[str]] = [[]]
        self.rows: list[list[str]] = []
        self.lists = self.unseen = 0
        block = {(t, False): lambda: self.blocks.append([]) for t in ("pre", "td", "th")}
        cell = {(t, True): lambda: self._leave(self._cell) for t in ("td", "th")}
        lists = {(t, c): lambda by=-1 if c else 1: self._nest(by) for t in ("ul", "ol") for c in (False, True)}
        unseen = {(t, c): lambda by=-1 if c else 1: self._hide(by) for t in ("script", "style", "head") for c in (False, True)}
        self.acts = {
            **block, **cell, **lists, **unseen, ("pre", True): lambda: self._leave(lambda t: self.handle_data("\n\n```\n" + t.strip("\n") + "\n```\n\n")),
            ("li", False): lambda: self.handle_data("\n" + "  " * max(0, self.lists - 1) + "- "), ("tr", False): lambda: self.rows.append([]),
            ("table", False): lambda: self.rows.clear(), ("table", True): self._draw, ("code", False): self._tick, ("code", True): self._tick,
        }

    def handle_data(self, data):
        if not self.unseen:
            self.blocks[-1].append(data)

    def handle_starttag(self, tag, attrs):
        self._meet(tag, False)

    def handle_endtag(self, tag):
        self._meet(tag, True)

    def _meet(self, tag: str, closes: bool) -> None:
        self.handle_data(_MARKS.get(tag, ("", ""))[closes])
        self.acts.get((tag, closes), lambda: None)()

    def _nest(self, by: int) -> None:
        self.lists = max(0, self.lists + by)

    def _hide(self, by: int) -> None:
        self.unseen = max(0, self.unseen + by)

    def _tick(self) -> None:
        self.handle_data("`" if len(self.blocks) == 1 else "")

    def _leave(self, then) -> None:
        if len(self.blocks) > 1:
            then("".join(self.blocks.pop()))

    def _cell(self, text: str) -> None:
        if self.rows:
            self.rows[-1].append(" ".join(text.split()).replace("|", "\\|"))

    def _draw(self) -> None:
        self.handle_data(_grid([r for r in self.rows if r]))
        self.rows.clear()


def markdown_of(html: str) -> str:
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    return re.sub(r"\n{3,}", "\n\n", "".join("".join(b) for b in parser.blocks)).strip()


def html_to_markdown(pages: DataFrame) -> DataFrame:
    return _per_text(pages.selectExpr("page_id as doc_id", "html"), "html", markdown_of, "markdown", "string")


# ---- chunks, JSON, similarity


def chunks_of(text: str, limit: int = 8000) -> list[str]:
    """Pieces of about ``limit`` characters, cut at blank lines outside code fences and display maths; front matter is a piece of its own."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if len(text) <= limit:
        return [text] if text.strip() else []
    rows, pieces, begin, size, code, maths = text.split("\n"), [], 0, 0, False, False
    if re.fullmatch(r"\s*---\s*", rows[0]):
        close = next((i for i, r in enumerate(rows[1:], 1) if re.fullmatch(r"\s*---\s*", r)), None)
        if close is not None:
            pieces.append("\n".join(rows[: close + 1]) + "\n")
            begin = close + 1
    for i in range(begin, len(rows)):
        bare = rows[i].strip()
        code ^= bare.startswith(("```", "~~~"))
        maths ^= not code and bare == "$$"
        if i > begin and not bare and not code and not maths and size + len(rows[i]) + 1 > limit:
            pieces.append("\n".join(rows[begin:i]).strip("\n") + "\n")
            begin, size = i, 0
        size += len(rows[i]) + 1
    pieces.append("\n".join(rows[begin:]).strip("\n") + "\n")
    return [p for p in pieces if p.strip()]


def chunks(docs: DataFrame, limit: int = 8000) -> DataFrame:
    return _per_text(docs, "text", lambda t: chunks_of(t, limit), "chunks", "array<string>").selectExpr("doc_id", "posexplode(chunks) as (chunk, text)")


def mended_json(text: str) -> str | None:
    """A cut-off JSON object closed, backing off to the last complete element if need be; canonical text, or None."""
    at = text.find("{")
    if at < 0:
        return None
    body, closers, quoted, cuts = text[at:].rstrip(), [], False, []
    end = i = 0
    while i < len(body):
        c = body[i]
        if quoted:
            if c == "\\":
                i += 1
            quoted = c != '"' or c == "\\"
        elif c == '"':
            quoted = True
        elif c in "{[":
            closers.append("}" if c == "{" else "]")
        elif c in "}]":
            closers.pop()
            if not closers:
                end = i + 1
                break
        elif c == ",":
            cuts.append((i, "".join(reversed(closers))))
        i += 1
    tail = ("\\" if quoted and i > len(body) else "") + ('"' if quoted else "") + "".join(reversed(closers))
    tries = [body[:end] if end else body + tail, *(body[:at] + close for at, close in cuts[-1:])]
    for candidate in tries:
        try:
            found = json.loads(candidate)
        except ValueError:
            continue
        return json.dumps(found, sort_keys=True) if isinstance(found, dict) else None
    return None


def mend_json(rows: DataFrame) -> DataFrame:
    return _per_text(rows, "text", mended_json, "mended", "string")


def similarity(pairs: DataFrame) -> DataFrame:
    """doc_id, a, b -> Ratcliff-Obershelp ratio and token edit distance, of whole texts (``alignment``)."""

    def run(frames):
        for pdf in frames:
            a, b = pdf["a"].fillna(""), pdf["b"].fillna("")
            token = re.compile(r"\\[a-zA-Z]+|[A-Za-z0-9]+|\S").findall
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "ratio": [ratio(x, y) for x, y in zip(a, b)], "distance": [distance(token(x), token(y)) for x, y in zip(a, b)],
            })

    return pairs.mapInPandas(run, "doc_id long, ratio double, distance long")


# ---- per document


def _greedy(rows: DataFrame, order: list[str], take) -> DataFrame:
    """Rows of each doc in the given order, as far as take(chosen, row) accepts them; chosen starts empty for a doc.

    Documents are sorted within partitions and read as a stream, so that small documents cost no call each.
    """

    def run(batches):
        doc, chosen = object(), None
        for batch in batches:
            keep = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[0] != doc:
                    doc, chosen = row[0], set()
                keep.append(take(chosen, row))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.repartition("doc").sortWithinPartitions("doc", *order).mapInArrow(run, rows.schema)


def assign(scores: DataFrame, least: float) -> DataFrame:
    """doc, i, j, score -> one-to-one pairs of a document, the best score first (ties: i, then j)."""

    def take(chosen, row):
        _, i, j, _ = row
        free = (0, i) not in chosen and (1, j) not in chosen
        if free:
            chosen.update(((0, i), (1, j)))
        return free

    return _greedy(scores.select("doc", "i", "j", "score").where(F.col("score") >= least), [F.desc("score"), "i", "j"], take)


def non_overlapping(spans: DataFrame) -> DataFrame:
    """doc, start, end, score -> spans that meet no better one of the document (ties: start, end)."""

    def take(chosen, row):
        _, start, end, _ = row
        free = all(end <= a or start >= b for a, b in chosen)
        if free:
            chosen.add((start, end))
        return free

    return _greedy(spans.select("doc", "start", "end", "score"), [F.desc("score"), "start", "end"], take)


def adaptive_replay(attempts: DataFrame, every: int = 3, hard: float = 300.0) -> DataFrame:
    """Replay of a document's attempts, best first, re-ranked every few steps by what was seen so far only.

    Score: seconds over the document's mean, plus 0.5 for a page with an accept, less 0.25 for each reject on it. The
    replay stops when the next attempt would pass the hard limit. Gives doc, step, ord (of the log), accepted.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", ignore_index=True)
        static = (pdf["seconds"] / max(float(pdf["seconds"].mean()), 1e-9)).to_numpy()
        left, bonus, spent, out = list(range(len(pdf))), {}, 0.0, []
        page, won, cost = pdf["page"].fillna(-1).to_numpy(), pdf["accepted"].to_numpy(), pdf["seconds"].to_numpy()
        while left:
            if len(out) % every == 0:
                left.sort(key=lambda i: (-(static[i] + bonus.get(page[i], 0.0)), i))
            i = left.pop(0)
            if spent + cost[i] > hard:
                break
            spent += cost[i]
            bonus[page[i]] = bonus.get(page[i], 0.0) + (0.5 if won[i] else -0.25)
            out.append(i)
        return pd.DataFrame({"doc": pdf["doc"].iloc[0], "step": np.arange(1, len(out) + 1), "ord": pdf["ord"].to_numpy()[out], "accepted": won[out]})

    return attempts.groupBy("doc").applyInPandas(run, "doc long, step long, ord long, accepted boolean")


def renumbered(docs: DataFrame, offset: int) -> DataFrame:
    """Image markers i0001:f01 of a text shifted by offset."""
    shift = lambda m: f"i{int(m[1]) + offset:04d}{m[2]}"
    return _per_text(docs, "text", lambda t: re.sub(r"\bi(\d{4})(:f\d{2})\b", shift, t), "text", "string")
