"""Cleaned documents: the options of a request, personal data, images and their descriptions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import providers
from lectern.functions.text import redact_pii

#: What a request may say, as JSON; what it leaves out has its default.
OPTIONS = "extract_images boolean, pii_removal boolean, use_case string"
#: Characters of an image's page that its description is made from.
CONTEXT = 300


def options(config: Column) -> Column:
    """struct(extract_images, pii_removal, use_case) of a request's JSON; images are taken and personal data stay unless it says otherwise."""
    o = F.from_json(F.coalesce(config, F.lit("{}")), OPTIONS)
    return F.struct(F.coalesce(o["extract_images"], F.lit(True)).alias("extract_images"), F.coalesce(o["pii_removal"], F.lit(False)).alias("pii_removal"), F.coalesce(o["use_case"], F.lit("")).alias("use_case"))


def described(image: Column, pages: Column, describe: Callable[[Column], Column]) -> Column:
    """An image (struct(page, name)) with alternative text, from the beginning of the page of its number."""
    own = F.filter(pages, lambda p: p["page"] == image["page"])
    context = F.left(F.coalesce(F.get(own, F.lit(0))["text"], F.lit("")), F.lit(CONTEXT))
    return F.struct(image["page"].alias("page"), image["name"].alias("name"), describe(context).alias("alt"))


def cleaned_documents(docs: DataFrame, config: str = "config", describe: Callable[[Column], Column] | None = None) -> DataFrame:
    """``docs`` with markdown, pages and images as the request's options say.

    ``docs``: markdown, pages array<struct<page,text>>, images array<struct<page,name>>, and
    the request as JSON text in ``config``. Personal data are replaced in the markdown and
    in each page, before images are described, so a description holds none of them; a
    description goes behind the markdown, under the page's number, unless it is empty.
    """
    o = options(F.col(config))
    d = docs.withColumn("_o", o)
    hide = lambda c: F.when(F.col("_o.pii_removal"), redact_pii(c)).otherwise(c)
    d = d.withColumns({"markdown": hide(F.col("markdown")), "pages": F.transform("pages", lambda p: F.struct(p["page"].alias("page"), hide(p["text"]).alias("text")))})
    make = describe or providers.describe_image
    d = d.withColumn("images", F.when(F.col("_o.extract_images"), F.transform("images", lambda i: described(i, F.col("pages"), make))).otherwise(F.expr("cast(array() as array<struct<page:bigint,name:string,alt:string>>)")))
    number = lambda i: F.coalesce(i["page"].cast("string"), F.lit("?"))
    block = lambda i: F.concat(F.lit("<!-- image page:"), number(i), F.lit(" -->\n[Bild S."), number(i), F.lit("]: "), i["alt"])
    blocks = F.transform(F.filter("images", lambda i: F.coalesce(i["alt"], F.lit("")) != ""), block)
    return d.withColumn("markdown", F.array_join(F.concat(F.array("markdown"), blocks), "\n\n")).drop("_o")
