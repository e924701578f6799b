"""Documents into chunks: frontmatter, sections with their heading path, budgeted splitting, content-addressed ids."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from skein.functions import text as T

CHUNKS = "document_ref string, chunk_index int, level int, heading_hierarchy array<string>, body string, text string"
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
_TURN = re.compile(r"\n(?=\[\d{2}:\d{2}:\d{2}\]\s*\*\*)")
_HEADING = re.compile(r"^(#{1,6})\s+(.+)$", re.M)


def frontmatter_block(text: Column) -> Column:
    """The YAML between a leading --- and the first --- after it; null without one."""
    return F.when(text.startswith("---") & (F.instr(text.substr(F.lit(4), F.length(text)), "---") > 0), F.substring_index(text.substr(F.lit(4), F.length(text)), "---", 1))


def body_text(text: Column) -> Column:
    """The text after its frontmatter, without leading newlines."""
    block = frontmatter_block(text)
    return F.when(block.isNotNull(), F.regexp_replace(text.substr(F.length(block) + 7, F.length(text)), r"^\n+", "")).otherwise(text)


@F.pandas_udf(S.MapType(S.StringType(), S.StringType()))
def frontmatter_map(block: pd.Series) -> pd.Series:
    """Fields of a YAML block, lists joined by commas; empty for what is no mapping."""
    try:
        import yaml
    except ImportError:
        yaml = None

    def read(b: str | None) -> dict[str, str]:
        if not b:
            return {}
        if yaml is None:
            pairs = (line.partition(":") for line in b.splitlines() if ":" in line and not line.startswith((" ", "-")))
            found: object = {k.strip(): v.strip().strip("[]") for k, _, v in pairs}
        else:
            try:
                found = yaml.safe_load(b)
            except yaml.YAMLError:
                return {}
        if not isinstance(found, dict):
            return {}
        return {str(k): ",".join(str(x) for x in v) if isinstance(v, list) else "" if v is None else str(v) for k, v in found.items()}

    return block.map(read)


def title(fields: Column, body: Column, path: Column) -> Column:
    """Frontmatter title, else the first level-1 heading, else the file's stem."""
    heading = F.nullif(F.trim(F.regexp_extract(body, r"(?m)^# (.+)$", 1)), F.lit(""))
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    return F.coalesce(F.nullif(F.try_element_at(fields, F.lit("title")), F.lit("")), heading, stem)


def sections(documents: DataFrame) -> DataFrame:
    """document_ref, section_index, level, heading, body for documents (document_ref, body): one a heading, level 0 for what stands before.

    Lines are numbered inside their document and headings open a section; a document is one row, so that this needs no shuffle.
    """
    lines = F.split("body", "\n")
    number = F.transform(lines, lambda line, i: F.struct(i.alias("i"), line.alias("line"), line.rlike(r"^#{1,6}\s+.+$").alias("heads")))
    starts = F.transform(F.filter(number, lambda x: x["heads"]), lambda x: x["i"])
    rows = documents.where("body IS NOT NULL").select("document_ref", lines.alias("lines"), F.array_union(F.array(F.lit(0)), starts).alias("starts"))
    rows = rows.select("document_ref", "lines", "starts", F.posexplode("starts").alias("n", "begin"))
    end = F.coalesce(F.try_element_at("starts", (F.col("n") + 2)), F.size("lines"))
    part = F.slice("lines", F.col("begin") + 1, F.greatest(end - F.col("begin"), F.lit(0)))
    rows = rows.select("document_ref", "n", part.alias("part"))
    first = F.try_element_at("part", F.lit(1))
    headed = first.rlike(r"^#{1,6}\s+.+$")
    rest = F.when(headed, F.slice("part", 2, F.greatest(F.size("part"), F.lit(1)))).otherwise(F.col("part"))
    level = F.when(headed, F.length(F.regexp_extract(first, r"^(#{1,6})\s", 1))).otherwise(0)
    out = rows.select("document_ref", level.alias("level"), F.when(headed, F.trim(F.regexp_extract(first, r"^#{1,6}\s+(.+)$", 1))).alias("heading"), F.trim(F.regexp_replace(F.array_join(rest, "\n"), r"^\s+|\s+$", "")).alias("body"), "n")
    return out.where("level > 0 OR body <> ''").select("document_ref", F.col("n").alias("section_index"), "level", "heading", "body")


def hierarchy(sections: DataFrame) -> DataFrame:
    """Adds heading_hierarchy: the last heading of each higher level that no higher heading has closed since."""
    order = Window.partitionBy("document_ref").orderBy("section_index").rowsBetween(Window.unboundedPreceding, 0)
    rows = sections
    for k in range(1, 7):
        mark = F.when(F.col("level") == k, F.struct(F.col("section_index").alias("at"), F.col("heading").alias("heading")))
        rows = rows.withColumn(f"_h{k}", F.last(mark, ignorenulls=True).over(order))
    valid = []
    for k in range(1, 7):
        closed = [F.coalesce(F.col(f"_h{j}.at"), F.lit(-1)) > F.col(f"_h{k}.at") for j in range(1, k)]
        shown = (F.col("level") >= k) & F.col(f"_h{k}").isNotNull()
        for c in closed:
            shown = shown & ~c
        valid.append(F.when(shown, F.col(f"_h{k}.heading")))
    return rows.withColumn("heading_hierarchy", F.filter(F.array(*valid), lambda h: h.isNotNull() & (h != ""))).drop(*[f"_h{k}" for k in range(1, 7)])


def speaker_turns(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n(?=\[\d{2}:\d{2}:\d{2}\]\s*\*\*)"), lambda s: F.trim(s)), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    """Paragraphs if there are at least three blank lines, else the text; none for a blank one."""
    several = F.filter(F.transform(F.split(text, "\n\n"), lambda s: F.trim(s)), lambda s: s != "")
    whole = F.when(F.trim(text) != "", F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(F.split(text, "\n\n")) > 3, several).otherwise(whole)


def presplit(kind: Column, text: Column) -> Column:
    """By kind: speaker turns of meeting transcripts, paragraphs of voice notes, else the text as it is."""
    whole = F.when(F.trim(text) != "", F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.when(kind == "meeting_transcript", speaker_turns(text)).when(kind == "voicenote", paragraphs(text)).otherwise(whole)


def packed(text: str, budget: int, overlap: int) -> list[str]:
    """Sentences packed up to a token budget; a piece begins with the last sentences of the one before, over the overlap and one at least.

    Cuts are looked up in the running sum of the sentences' tokens: a piece ends before the first new sentence that passes the budget, its first new one excepted.
    """
    sentences = [x for x in map(str.strip, _SENTENCE.split(text)) if x]
    ends = np.concatenate([[0], np.cumsum([max(1, len(x.encode()) // 4) for x in sentences], dtype=np.int64)])
    pieces, begin, fresh = [], 0, 0
    while fresh < len(sentences):
        end = max(fresh + 1, int(np.searchsorted(ends, ends[begin] + budget, side="right")) - 1)
        pieces.append(" ".join(sentences[begin:end]))
        shared = int(np.searchsorted(ends, ends[end] - overlap))
        begin, fresh = max(begin, min(shared, end - 1)), end
    return pieces


def chunked(documents: DataFrame, budget: int = 512, overlap: int = 50) -> DataFrame:
    """Chunks of documents (document_ref, kind, text): CHUNKS rows with running chunk_index.

    A document is a row and is cut where it lies. Null and blank texts give no chunks; text is the heading path, a blank line and the body.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for ref, kind, text in frame.itertuples(index=False):
                index = 0
                for level, path, body in _sections(text or ""):
                    parts = _TURN.split(body) if kind == "meeting_transcript" else body.split("\n\n") if kind == "voicenote" and body.count("\n\n") >= 3 else [body]
                    for part in (p.strip() for p in parts if p.strip()):
                        head = " > ".join(path) + "\n\n" if path else ""
                        for piece in [part] if len((head + part).encode()) // 4 <= budget else packed(part, budget, overlap):
                            out.append((ref, index, level, path, piece, head + piece))
                            index += 1
            yield pd.DataFrame(out, columns=["document_ref", "chunk_index", "level", "heading_hierarchy", "body", "text"])

    return documents.select("document_ref", "kind", "text").mapInPandas(run, CHUNKS)


def _sections(text: str) -> Iterator[tuple[int, list[str], str]]:
    if text.startswith("---") and "---" in text[3:]:
        text = text[3:].partition("---")[2].lstrip("\n")
    marks = list(_HEADING.finditer(text))
    before = text[: marks[0].start()] if marks else text
    if before.strip():
        yield 0, [], before
    stack: dict[int, str] = {}
    for m, after in zip(marks, [*marks[1:], None], strict=False):
        level = len(m.group(1))
        stack = {k: v for k, v in stack.items() if k < level} | {level: m.group(2).strip()}
        yield level, [stack[k] for k in sorted(stack) if stack[k]], text[m.end() : after.start() if after else len(text)]


def identified(chunks: DataFrame, kind: Column, strategy: Column) -> DataFrame:
    return chunks.withColumn("chunk_id", T.chunk_id(kind, F.col("body"), F.col("chunk_index"), strategy))


def message_chunk_text(dialog: Column, sender: Column, sent_at: Column, topic: Column, reply: Column, text: Column) -> Column:
    """Context lines of what is known of a message, a blank line, and its text."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string")))
    lines = F.concat_ws("\n", line("Dialog", dialog), line("Sender", sender), line("Sent", F.date_format(sent_at, "yyyy-MM-dd'T'HH:mm:ss")), line("Topic", topic), line("Reply to", reply))
    return F.concat(lines, F.lit("\n\n"), F.coalesce(text, F.lit("")))


@F.udf(S.ArrayType(S.StringType()), useArrow=True)
def segments(text: str | None, most: int = 320) -> list[str]:
    """A text in segments of at most `most` words: sentences packed, longer sentences cut."""
    if not text or not text.strip():
        return []
    if len(text.split()) <= most:
        return [text]
    out, held = [], []
    for s in _SENTENCE.split(text):
        words = s.split()
        while len(words) > most:
            if held:
                out.append(" ".join(held))
                held = []
            out.append(" ".join(words[:most]))
            words = words[most:]
        if held and len(held) + len(words) > most:
            out.append(" ".join(held))
            held = []
        held += words
    return [*out, " ".join(held)] if held else out


def index_rows(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks as the index holds them: the title is the last heading or the document's, with tags and paths."""
    titles = documents.groupBy("ref").agg(F.max("title").alias("document_title"))
    heading = F.nullif(F.try_element_at("heading_hierarchy", F.lit(-1)), F.lit(""))
    rows = chunks.drop("document_title").join(titles, "ref", "left")
    return rows.withColumn("index_title", F.coalesce(heading, "document_title", F.lit(""))).drop("document_title")


def meta_text(title: Column, tags: Column, namespace: Column, media_type: Column, collection: Column) -> Column:
    """What is embedded besides the text: title and tags of files; namespace, title, type and dialog of messages."""
    return F.when(namespace == "filesystem", F.trim(F.concat_ws(" ", title, F.array_join(tags, ", ")))).otherwise(F.concat_ws(" ", namespace, title, media_type, collection))


@F.udf(S.StringType(), useArrow=True)
def mail_body(payload: str | None, most: int = 1 << 20) -> str:
    """Text of a MIME payload in JSON: plain text before HTML, parts inside parts, cut at `most` bytes with a mark."""
    import base64
    import html
    import json

    def decoded(part: dict) -> str:
        data = (part.get("body") or {}).get("data") or ""
        try:
            return base64.urlsafe_b64decode(data + "=" * (-len(data) % 4)).decode("utf-8", "replace")
        except ValueError:
            return ""

    def find(part: dict, wanted: str) -> str:
        if str(part.get("mimeType", "")).startswith(wanted):
            return decoded(part)
        return next((t for p in part.get("parts") or [] if (t := find(p, wanted))), "")

    try:
        root = json.loads(payload or "{}")
    except ValueError:
        return ""
    if not isinstance(root, dict):
        return ""
    text = find(root, "text/plain")
    if not text:
        markup = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", find(root, "text/html"))
        text = re.sub(r"\s+", " ", html.unescape(re.sub(r"(?s)<[^>]+>", " ", markup))).strip()
    raw = text.encode()
    return text if len(raw) <= most else raw[:most].decode("utf-8", "ignore") + "[truncated]"
