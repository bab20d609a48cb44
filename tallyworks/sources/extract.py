"""Bytes to invoice rows, layer by layer: XML, text, QR codes.

Python opens each file once and returns what its layers hold (a tag index, a text, QR payloads); all
fields, merges, checks and categories are column expressions over that, so they run in the JVM.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import is_complete
from ..functions.qr import apply_reading, parse_payload
from ..functions.text import file_hash, has_usable_text, parse_text
from ..operators.validate import infer_and_check
from ..schema import FILE_KINDS, INVOICE
from .einvoice import INDEX, blank_invoice, index_xml, is_invoice, no_items, parse_index
from .files import decode, detect
from .ofd import read_ofd
from .pdf import read_pdf

#: Reads the QR payloads of an image {"data", "width", "height", "format"}; none is built in, as no image library is at hand.
QrDecoder = Callable[[dict], list[str]]
LAYERS = T.StructType(
    [
        T.StructField("index", INDEX),
        T.StructField("text", T.StringType()),
        T.StructField("payloads", T.ArrayType(T.StringType())),
        T.StructField("images", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
)
TRACE = "array<struct<layer: string, hit: boolean, detail: string>>"


def open_layers(kind: str, content: bytes, qr: QrDecoder | None = None) -> dict:
    """What a file's layers hold; an error of a reader is noted, never raised."""
    out: dict = {"index": None, "text": None, "payloads": [], "images": 0, "error": None}
    images: list[dict] = []
    try:
        if kind == "pdf":
            found = read_pdf(content)
            out["index"] = next((i for x in found["xml"] if is_invoice(i := index_xml(x))), None)
            out["text"], images = found["text"], found["images"]
        elif kind == "ofd":
            out |= read_ofd(content)
        elif kind == "image":
            images = [{"data": content, "width": 0, "height": 0, "format": "file"}]
        elif kind == "xml":
            index = index_xml(decode(content))
            out["index"] = index if is_invoice(index) else None
    except Exception as e:  # a corrupt file is a row with nothing in it, not a failed job
        out["error"] = str(e)
    out["images"] = len(images)
    if qr and out["index"] is None:
        for image in images:
            try:
                out["payloads"].extend(qr(image))
            except Exception:  # an image that can't be read has no code
                continue
    return out


def layers(qr: QrDecoder | None = None):
    @F.pandas_udf(LAYERS)
    def run(kind: pd.Series, content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([open_layers(k, bytes(c), qr) for k, c in zip(kind, content, strict=True)], columns=LAYERS.fieldNames())

    return run


def _step(layer: str, hit: bool | Column, detail: str | Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(layer).alias("layer"), lit(hit).alias("hit"), lit(detail).alias("detail"))


def extract(files: DataFrame, today: datetime.date, qr: QrDecoder | None = None) -> DataFrame:
    """(path, content) rows to invoice rows with trace, file_kind and has_image, inferred and checked."""
    opened = files.withColumn("file_kind", detect(F.col("content"), F.col("path"))).select(
        "path", file_hash(F.col("content")).alias("file_hash"), "file_kind", layers(qr)(F.col("file_kind"), F.col("content")).alias("l")
    )
    names = [f for f in INVOICE.fieldNames() if f in blank_invoice()]
    opened, xml = parse_index(opened, F.col("l.index"))
    opened, drawn = parse_text(opened, F.col("l.text"))
    drawn, blank = {**drawn, "items": no_items()}, blank_invoice()
    as_struct = lambda parts: F.struct(*[parts[n].cast(INVOICE[n].dataType).alias(n) for n in names])

    kind, usable = F.col("file_kind"), has_usable_text(F.col("l.text"))
    by_text = (kind == "ofd") | ((kind == "pdf") & usable)
    first = F.when(F.col("l.index").isNotNull(), as_struct(xml)).when(by_text & F.col("l.error").isNull(), as_struct(drawn)).otherwise(as_struct(blank))
    rows = opened.withColumn("i", first).select("path", "file_hash", "file_kind", "l", *[F.col(f"i.{n}").alias(n) for n in names])

    # codes are read where neither XML nor a complete text decided
    codes = F.filter(F.transform("l.payloads", parse_payload), lambda x: x.isNotNull())
    wanted = F.col("l.index").isNull() & (kind.isin("pdf", "image")) & ~((kind == "pdf") & usable & is_complete())
    rows = rows.withColumn("q", F.when(wanted, F.get(codes, 0))).withColumn("_complete", is_complete())
    merged = apply_reading(F.col("q"), {n: F.col(n) for n in names})
    with_code = rows.withColumns({f"_{n}": F.when(F.col("q").isNotNull(), merged[n]).otherwise(F.col(n)) for n in names})
    label = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in FILE_KINDS.items()])
    text_hit = F.col("number.value").isNotNull()
    trace = F.array_compact(
        F.array(
            _step("文件类型", True, label),
            F.when(F.col("l.error").isNotNull(), _step("读取", False, F.col("l.error"))),
            F.when((kind == "pdf") & F.col("l.error").isNull(), _step("PDF 内嵌 XML", F.col("l.index").isNotNull(), F.when(F.col("l.index").isNotNull(), "找到发票 XML 附件，字段权威").otherwise("无 XML 附件"))),
            F.when((kind == "pdf") & F.col("l.index").isNull() & F.col("l.error").isNull(), _step("PDF 文本层", usable, F.when(usable, "从文本层解析字段").otherwise("无文本层，按扫描件处理"))),
            F.when((kind == "ofd") & F.col("l.index").isNotNull(), _step("OFD 附件 XML", True, "找到发票 XML，字段权威")),
            F.when((kind == "ofd") & F.col("l.index").isNull() & F.col("l.error").isNull(), _step("OFD 版面文本", text_hit, F.when(text_hit, "从页面文本解析字段").otherwise("页面文本中未找到发票号码"))),
            F.when(kind == "xml", _step("发票 XML", F.col("l.index").isNotNull(), F.when(F.col("l.index").isNotNull(), "字段权威").otherwise("不是可识别的电子发票 XML"))),
            F.when(kind == "zip", _step("压缩包", False, "需要先解压，逐个导入")),
            F.when(kind == "unknown", _step("未知格式", False, "无法识别的文件类型")),
            F.when(wanted & (F.col("l.images") == 0), _step("图像", False, "文件中没有可用的位图")),
            F.when(wanted & (F.col("l.images") > 0), _step("二维码", F.col("q").isNotNull(), F.when(F.col("q").isNotNull(), "解出发票号码与金额").otherwise("未找到可识别的发票二维码"))),
        )
    ).cast(TRACE)
    out = with_code.select(
        F.lit(None).cast("bigint").alias("id"),
        *[F.col(f"_{n}").alias(n) for n in names],
        F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("string").alias("category_rule"),
        F.col("path").alias("source_path"),
        "file_hash",
        F.array().cast(INVOICE["issues"].dataType).alias("issues"),
        "file_kind",
        (wanted & (F.col("l.images") > 0)).alias("has_image"),
        trace.alias("trace"),
    )
    checked = infer_and_check(out, today)
    return checked.withColumn("has_image", F.col("has_image") & ~is_complete()).select(*INVOICE.fieldNames(), "file_kind", "has_image", "trace")
