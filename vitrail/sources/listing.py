"""Files of folders, their text metadata, and reports."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrail.functions import text

#: Bytes of a file that are searched for a metadata packet.
PACKET_BYTES = 4 << 20
INDEX_FOLDER = ".image-index"
# Metadata tags by number.
EXIF_TAGS = {0x010E: "ImageDescription", 0x9286: "UserComment", 0x9C9B: "XPTitle", 0x9C9C: "XPComment", 0x9C9E: "XPKeywords", 0x9C9F: "XPSubject", 0x0112: "Orientation"}


def list_images(spark: SparkSession, roots: list[str], index_folder: str = INDEX_FOLDER) -> DataFrame:
    """(root, path, size, modified in whole seconds) of the supported files below each root; the index folder is left out. No content is read."""
    out = None
    for root in roots:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        plain = F.regexp_replace("path", "^file:/*", "/")
        rows = files.select(F.lit(root).alias("root"), plain.alias("path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("modified"))
        rows = rows.where(text.is_supported_image(F.col("path")) & ~F.contains(F.col("path"), F.lit(f"/{index_folder}/")))
        out = rows if out is None else out.unionByName(rows)
    return out


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the supported files below a root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content").where(text.is_supported_image(F.col("path")))


def exif_fields(data: bytes) -> dict[str, str]:
    """Text tags and the orientation of a JPEG's or TIFF's first directories; broken data gives what was read before."""
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF:
            n = struct.unpack(">H", data[at + 2 : at + 4])[0]
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return _directory(data[at + 10 : at + 2 + n])
            if data[at + 1] == 0xDA:
                break
            at += 2 + n
        return {}
    return _directory(data) if data[:4] in (b"II*\0", b"MM\0*") else {}


def _directory(tiff: bytes) -> dict[str, str]:
    order = "<" if tiff[:2] == b"II" else ">"
    out: dict[str, str] = {}
    try:
        pending, seen = [struct.unpack(order + "I", tiff[4:8])[0]], set()
        while pending:
            start = pending.pop()
            if start in seen:
                continue
            seen.add(start)
            (entries,) = struct.unpack(order + "H", tiff[start : start + 2])
            for k in range(entries):
                tag, kind, n = struct.unpack(order + "HHI", tiff[start + 2 + 12 * k : start + 10 + 12 * k])
                field = tiff[start + 10 + 12 * k : start + 14 + 12 * k]
                if tag == 0x8769:
                    pending.append(struct.unpack(order + "I", field)[0])
                elif tag in EXIF_TAGS:
                    if kind == 3:
                        out[EXIF_TAGS[tag]] = str(struct.unpack(order + "H", field[:2])[0])
                        continue
                    at = struct.unpack(order + "I", field)[0]
                    raw = field[:n] if n <= 4 else tiff[at : at + n]
                    coding = "utf-16-le" if EXIF_TAGS[tag].startswith("XP") else "utf-8"
                    if tag == 0x9286:
                        raw = raw[8:]
                    out[EXIF_TAGS[tag]] = raw.decode(coding, "replace").strip("\0 ")
    except (struct.error, IndexError):
        pass
    return out


def text_metadata(files: DataFrame) -> DataFrame:
    """(path, description, keywords, orientation) of files (path, content), from their tags and the packet in their first 4 MiB."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                data = bytes(content)[:PACKET_BYTES]
                fields = exif_fields(data)
                rows.append((path, data.decode("utf-8", "replace"), {k: v for k, v in fields.items() if k != "Orientation"}, int(fields.get("Orientation", 1))))
            yield pd.DataFrame(rows, columns=["path", "packet", "tags", "orientation"])

    raw = files.select("path", "content").mapInPandas(run, "path string, packet string, tags map<string,string>, orientation int")
    described, keyed = text.packet_text(F.col("packet"))
    entries = F.transform(F.map_entries("tags"), lambda e: F.struct(text.tag_route(e["key"]).alias("to"), text.collapse_space(e["value"]).alias("value")))
    of = lambda name: F.transform(F.filter(entries, lambda e: e["to"][name] & (e["value"] != "")), lambda e: e["value"])
    both = lambda a, b, sep: F.array_join(text.dedup_keep_first(F.concat(a, F.when(b != "", F.split(b, sep)).otherwise(F.array().cast("array<string>")))), sep.replace("\\", ""))
    return raw.select("path", both(of("description"), described, " \\| ").alias("description"), both(of("keywords"), keyed, ", ").alias("keywords"), "orientation")


def write_report(metrics: DataFrame, folder: str) -> None:
    """Metrics (metric, value) as lines key=value in one small file."""
    line = F.concat(text.report_key(F.col("metric")), F.lit("="), text.one_line(F.coalesce(F.col("value").cast("string"), F.lit(""))))
    metrics.orderBy("metric").select(line.alias("value")).coalesce(1).write.mode("overwrite").text(folder)
