"""Container images as tables: layouts of index, manifest and blobs become rows of layer entries.

Manifests are small blobs and tell the layers of an image; a layer is one partition's work and its tar
is read as a stream, so neither an image nor an unpacked layer is held whole.
"""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json import jparts, jstr, ju64
from ..operators.layers import within_budget

#: Bytes that an image's unpacked layers may have, and how many layers.
MAX_EXPORT, MAX_LAYERS = 2 << 30, 256
#: The layer types that are read.
LAYER_TYPES = (
    "application/vnd.oci.image.layer.v1.tar", "application/vnd.oci.image.layer.v1.tar+gzip", "application/vnd.oci.image.layer.v1.tar+zstd", "application/vnd.docker.image.rootfs.diff.tar", "application/vnd.docker.image.rootfs.diff.tar.gzip",
    "application/vnd.oci.image.layer.nondistributable.v1.tar", "application/vnd.oci.image.layer.nondistributable.v1.tar+gzip",
)
#: A manifest is no larger.
MANIFEST = 4 << 20
ENTRIES = "image string, layer_no int, entry_no int, path string, entry_type string, link_target string, body binary, bytes long, error string"
_ARROW = pa.schema([("image", pa.string()), ("layer_no", pa.int32()), ("entry_no", pa.int32()), ("path", pa.string()), ("entry_type", pa.string()), ("link_target", pa.string()), ("body", pa.binary()), ("bytes", pa.int64()), ("error", pa.string())])
_KINDS = {tarfile.REGTYPE: "file", tarfile.AREGTYPE: "file", tarfile.CONTTYPE: "file", tarfile.DIRTYPE: "dir", tarfile.SYMTYPE: "symlink", tarfile.LNKTYPE: "hardlink"}


class _Capped(io.RawIOBase):
    """Reads at most ``cap`` bytes of another stream; more is an error."""

    def __init__(self, source, cap: int):
        self.source, self.left = source, cap

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.source.read(min(len(buffer), self.left + 1))
        if len(data) > self.left:
            raise OverflowError("layer exceeds the export size cap")
        self.left -= len(data)
        buffer[: len(data)] = data
        return len(data)


def _opened(content: bytes, kind: str):
    raw = io.BytesIO(content)
    if kind.endswith("gzip"):
        return gzip.GzipFile(fileobj=raw)
    if kind.endswith("zstd"):
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
    return raw


def layer_entries(content: bytes, kind: str, cap: int = MAX_EXPORT) -> Iterator[tuple]:
    """(entry number, path, type, link target, body, error) of a layer's tar, in order; an unreadable rest is one error row."""
    n = -1
    try:
        with tarfile.open(fileobj=io.BufferedReader(_Capped(_opened(content, kind), cap), 1 << 16), mode="r|") as tar:
            for n, member in enumerate(tar):
                body = tar.extractfile(member).read() if member.isreg() else None
                yield n, member.name, _KINDS.get(member.type, "other"), member.linkname or None, body, None
    except Exception as e:  # a layer from outside may be anything; it must not cost the other images
        yield n + 1, None, None, None, None, f"{type(e).__name__}: {e}"


def layers(spark: SparkSession, path: str) -> DataFrame:
    """(image, layer_no, digest, kind, declared, error) of the image layouts under a folder, one layout a sub-folder.

    The first manifest for linux/amd64, else the first one, counts. Images of more than ``MAX_LAYERS``
    layers or with a layer of another type are one row with an error.
    """
    root = path.rstrip("/")
    name = lambda parts: F.element_at(F.split(F.col("_metadata.file_path"), "/"), -parts)
    index = spark.read.option("wholetext", True).text(f"{root}/*/index.json").select(name(2).alias("image"), F.try_parse_json("value").alias("doc"))
    each = F.transform(jparts(F.col("doc"), "$.manifests"), lambda m, i: F.struct(F.when((jstr(m, "$.platform.os") == "linux") & (jstr(m, "$.platform.architecture") == "amd64"), 0).otherwise(1).alias("rank"), i.alias("i"), jstr(m, "$.digest").alias("digest")))
    chosen = index.select("image", F.array_min(each)["digest"].alias("digest"))
    small = spark.read.format("binaryFile").load(f"{root}/*/blobs/sha256/*").where(F.col("length") <= MANIFEST)  # read no further than the length
    blobs = small.select(name(4).alias("image"), F.concat(F.lit("sha256:"), name(1)).alias("digest"), F.col("content").cast("string").alias("text"))
    found = chosen.join(blobs, ["image", "digest"], "left").select("image", jparts(F.try_parse_json("text"), "$.layers").alias("layers"))
    kinds = F.transform("layers", lambda x: F.coalesce(jstr(x, "$.mediaType"), F.lit("")))
    error = F.when(F.col("layers").isNull(), "no manifest").when(F.size("layers") > MAX_LAYERS, F.concat(F.lit("too many layers: "), F.size("layers"))).when(F.exists(kinds, lambda k: ~k.isin(*LAYER_TYPES)), "layer of an unknown type")
    rows = found.withColumn("error", error)
    one = F.when(F.col("error").isNotNull(), F.array(F.lit(None).cast("variant"))).otherwise(F.col("layers"))
    return rows.select("image", "error", F.posexplode_outer(one).alias("layer_no", "x")).select("image", F.col("layer_no").cast("int"), jstr(F.col("x"), "$.digest").alias("digest"), jstr(F.col("x"), "$.mediaType").alias("kind"), ju64(F.col("x"), "$.size").alias("declared"), "error")


def entries(spark: SparkSession, path: str, cap: int = MAX_EXPORT) -> DataFrame:
    """Rows of ``ENTRIES`` for the images under a folder; layers are dealt over tasks by (image, layer).

    ``bytes`` is an entry's size. What can't be read is a row with an error: an image without a manifest, a
    missing blob, a broken tar, a layer that unpacks to more than ``cap``.
    """
    root = path.rstrip("/")
    parts = F.split("path", "/")
    blobs = spark.read.format("binaryFile").load(f"{root}/*/blobs/sha256/*").select(F.element_at(parts, -4).alias("image"), F.concat(F.lit("sha256:"), F.element_at(parts, -1)).alias("digest"), "content")
    told = layers(spark, path)
    dealt = told.join(blobs, ["image", "digest"], "left").select("image", "layer_no", "kind", "content", "error").repartition("image", "layer_no")

    def run(batches):
        for batch in batches:
            for image, layer, kind, content, error in zip(*(c for c in batch.columns)):
                why = error.as_py() or (None if content.is_valid else "missing blob")
                found = [(None, None, None, None, None, why)] if why else layer_entries(content.as_py(), kind.as_py(), cap)
                rows, held = [], 0
                for n, name, what, link, body, failed in found:
                    rows.append((image.as_py(), layer.as_py(), n, name, what, link, body, len(body or b""), failed))
                    held += 256 + len(body or b"")
                    if held > 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return dealt.mapInArrow(run, ENTRIES)


def whole_images(rows: DataFrame, max_bytes: int = MAX_EXPORT, max_layers: int = MAX_LAYERS) -> DataFrame:
    """``entries``' rows of images without an error whose layers are few and small enough together; the rest is refused whole."""
    sizes = rows.groupBy("image", "layer_no").agg(F.sum("bytes").alias("bytes"), F.count("error").alias("errors"))
    broken = sizes.where("errors > 0").select("image").distinct()
    sound = within_budget(sizes, max_layers=max_layers, max_bytes=max_bytes).join(broken, "image", "left_anti").select("image")
    return rows.join(sound, "image")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
