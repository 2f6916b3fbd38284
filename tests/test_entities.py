"""References against the standard library's decoder."""

import html
import random
from html.entities import html5

from pyspark.sql import functions as F

from tallywell.functions import entities


def texts(seed=3):
    r = random.Random(seed)
    names = sorted(html5)
    odd = ["&amp;lt;", "&notit;", "&notin;", "&", "&&amp;", "&;", "&#;", "&#x;", "&#xZ;", "&copy", "&copyright", "&eacute;", "&eacutex", "&#x27;", "&#X27", "&#39",
           "&#0;", "&#128;", "&#x81;", "&#159;", "&#13;", "&#1;", "&#xD800;", "&#x110000;", "&#99999999999999999999;", "&#000000000000065;", "&#xFFFE;", "&#x1FFFF;", "&#xFDD0;",
           "&#128512;", "&nosuchname;", "&AMP;&Amp;", "a&b=1&c;", "", " ", "no reference at all", "Stra&szlig;e &mdash; &ldquo;x&rdquo;", "&#11;", "&#127;", "&#9;&#10;"]
    mixed = ["".join(r.choice([f"&{r.choice(names)}", f"&{r.choice(names).rstrip(';')}", f"&#{r.randrange(1200000)};", f"&#x{r.randrange(70000):x}", "x", " ", "&", ";", "1"])
                     for _ in range(r.randrange(12))) for _ in range(1500)]
    return odd + [f"&{n}" for n in names] + mixed + ["&lt;" * 20_000]


def test_as_the_standard_library(spark):
    made = spark.createDataFrame([(t,) for t in texts()] + [(None,)], "t string").select("t", entities.decode(F.col("t")).alias("plain")).collect()
    wrong = [(row["t"], row["plain"]) for row in made if row["plain"] != (None if row["t"] is None else html.unescape(row["t"]))]
    assert wrong == []
