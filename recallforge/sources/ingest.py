"""Files into documents and records, JSON projections, and code chunks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallforge.functions.text import CHUNK_TOKENS, checksum

KINDS = {"txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "json": "application/json"}

#: Beginnings of a line that open a new segment of code, by language. Fixed values.
OPENERS = {
    "rust": ["pub async fn ", "async fn ", "pub fn ", "fn ", "pub struct ", "struct ", "pub enum ", "enum ", "pub impl ", "impl ", "pub trait ", "trait ", "pub mod ", "mod ", "pub const ", "const ", "pub static ", "static ", "macro_rules!"],
    "python": ["def ", "async def ", "class "],
    "javascript": ["async function ", "function ", "class ", "export default ", "export function ", "export class ", "export async function ", "const ", "let ", "var "],
    "go": ["func ", "type ", "var ", "const "],
    "java": ["public class ", "class ", "public interface ", "interface ", "public enum ", "enum ", "public ", "private ", "protected "],
}
#: Other names of these languages. Fixed values.
LANGUAGES = {"typescript": "javascript", "js": "javascript", "ts": "javascript", "kotlin": "java"}


def files(spark: SparkSession, path: str, pdf: Callable[[bytes], str] | None = None) -> DataFrame:
    """path, file_id (the path below the folder), name, extension, media_type, size_bytes, checksum and text of the txt, md, csv and json files of a folder, or of one file.

    Any other extension raises an error when it is read, and so does a file that is not UTF-8. A PDF goes through pdf, a function
    from its bytes to its text; no such function comes with this package.
    """
    raw = spark.read.format("binaryFile").load(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = str(at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at)).rstrip("/") + "/"
    name = F.element_at(F.split("path", "/"), -1)
    below = F.when(F.col("path").startswith(root), F.substring(F.col("path"), F.lit(len(root) + 1), F.length("path"))).otherwise(name)
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    kinds = KINDS | ({"pdf": "application/pdf"} if pdf else {})
    media = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))[extension]
    why = F.when(extension == "pdf", "there is no PDF reader here, pass one as pdf: ").otherwise("this kind of file cannot be imported: ")
    known = F.coalesce(media, F.raise_error(F.concat(why, name)).cast("string"))
    text = F.decode("content", "UTF-8")
    if pdf:
        read = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else pdf(bytes(x))), "string")
        text = F.when(extension == "pdf", read(F.when(extension == "pdf", F.col("content")))).otherwise(F.when(extension != "pdf", text))
    return raw.select("path", below.alias("file_id"), name.alias("name"), extension.alias("extension"), known.alias("media_type"), F.col("length").alias("size_bytes"), checksum(text).alias("checksum"), text.alias("text"))


def documents(files_: DataFrame, tenant: str, collection: str, now_ms: int) -> DataFrame:
    """Documents of imported files, with the file's facts as metadata and as columns."""
    keys = ("file_id", "file_name", "media_type", "checksum")
    meta = F.create_map(*(x for k, c in zip(keys, ("file_id", "name", "media_type", "checksum")) for x in (F.lit(k), F.col(c))))
    text = F.when(F.col("extension") == "json", projection(F.regexp_replace("name", r"\.[^.]+$", ""), F.col("name"), F.when(F.col("extension") == "json", F.col("text")))).otherwise(F.col("text"))
    return files_.select(F.concat(F.lit("file:"), "file_id").alias("id"), F.lit(tenant).alias("tenant_id"), F.lit(collection).alias("collection"), text.alias("text"), meta.alias("metadata"), F.lit(now_ms).alias("created_at"), "path", "file_id", "name", "media_type", "checksum", "size_bytes")


def csv_records(lines: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """One record for each line after the header: payload is a map of trimmed texts, missing cells empty. Quotes have no meaning here."""
    rows = F.filter(F.split(F.regexp_replace(text, "\r\n", "\n"), "\n"), lambda x: F.trim(x) != "")
    cells = lambda x: F.transform(F.split(x, ","), lambda y: F.trim(y))
    spread = lines.select(path, cells(F.get(rows, F.lit(0))).alias("header"), F.posexplode(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))).alias("row", "line"))
    values = F.transform("header", lambda _, i: F.coalesce(F.get(cells(F.col("line")), i), F.lit("")))
    stem = F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)
    return spread.select(path, stem.alias("table"), F.col("row").cast("long"), F.map_from_arrays("header", values).alias("payload"))


def json_records(lines: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """One record for each element of a JSON array; its payload as JSON text."""
    parts = F.from_json(text, "array<variant>")
    stem = F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)
    return lines.select(path, stem.alias("table"), F.posexplode(parts).alias("row", "v")).select(path, "table", F.col("row").cast("long"), F.to_json("v").alias("payload"))


def json_words(payload: str | None) -> str:
    """Keys in sorted order, each with its value; arrays and objects flattened."""
    def walk(x) -> Iterator[str]:
        if isinstance(x, dict):
            for k in sorted(x):
                yield k
                yield from walk(x[k])
        elif isinstance(x, list):
            for y in x:
                yield from walk(y)
        elif isinstance(x, str):
            yield x
        else:
            yield json.dumps(x)

    return " ".join(walk(json.loads(payload))) if payload else ""


def projection(table: Column, key: Column, payload: Column) -> Column:
    """The searchable text of a record: its table, its id and the words of its payload."""
    words = F.pandas_udf(lambda s: s.map(json_words), "string")
    return F.concat_ws(" ", F.lit("table"), table, F.lit("record"), key, words(payload))


def code_chunks(text: str, language: str, budget: int = CHUNK_TOKENS) -> list[str]:
    """Segments that begin at an opening line without indentation. A segment joins the chunk before it if both fit into the budget of words; one beyond the budget is
    cut into groups of words, and the chunk before it, if there is one, ends in a line feed."""
    starts = tuple(OPENERS.get(LANGUAGES.get(language, language), ()))
    groups = lambda words: [" ".join(words[i : i + budget]) for i in range(0, len(words), budget)]
    parts: list[list[str]] = []
    for line in (x.removesuffix("\r") for x in text.removesuffix("\n").split("\n")):
        if not parts or starts and line.startswith(starts):
            parts.append([])
        parts[-1].append(line)
    segments = [x for x in map("\n".join, parts) if x.strip()]
    if not starts or not segments:
        return groups(text.split())
    out: list[str] = []
    for x in segments:
        words = x.split()
        if len(words) > budget:
            out = [*out[:-1], *(y if y.endswith("\n") else y + "\n" for y in out[-1:]), *groups(words)]
        elif out and len(out[-1].split()) + len(words) <= budget:
            out[-1] += "\n" + x
        else:
            out.append(x)
    return out


def with_code_chunks(df: DataFrame, text: str = "text", language: str = "language", budget: int = CHUNK_TOKENS) -> DataFrame:
    """df with a row for each code chunk: ordinal and chunk."""
    cut = F.pandas_udf(lambda t, lang: pd.Series([code_chunks(x or "", y or "", budget) for x, y in zip(t, lang)]), "array<string>")
    return df.select("*", F.posexplode(cut(F.col(text), F.col(language))).alias("ordinal", "chunk"))
