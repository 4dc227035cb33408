"""License scans: TF-IDF cosine of lines, blocks and whole files to templates, inherited down the directories.

DataFrame functions only.
"""

from __future__ import annotations

import functools
import itertools
import json
import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import cut, rows_below

#: Short public notices by SPDX identifier.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
)
#: The notices that licences ask to put at the head of each source file.
HEADERS: tuple[tuple[str, str], ...] = (
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 "
        "of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with "
        "this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with "
        "this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General "
        "Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either "
        "version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General "
        "Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/.",
    ),
)
#: Licences whose whole public texts are in the folder ``texts``.
WHOLE = ("Apache-2.0", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense")
#: Least cosine of a line, block or file with a template.
THRESHOLD = 0.75
#: Rows of the directory table (about 100 bytes each), of the words' weights, of the parts that may match and of the licences found that may be broadcast.
BROADCAST_ROWS = 100_000
SALTS = 16
#: The part that is a whole text; lines count from 0 up, blocks from -2 down.
WHOLE_TEXT = -1
WORD_BREAK = "[^a-z0-9]+"
#: Words whose frequencies bound the lengths of vectors from below; of more words the others count nothing.
COMMON = 2000
#: Between blocks: lines of white space only.
BLOCK_BREAK = "\n[ \t\r]*\n"


def words(text: str) -> list[str]:
    return [w for w in re.split(WORD_BREAK, text.lower()) if w]


@functools.cache
def templates() -> tuple[tuple[str, str], ...]:
    """Short notices, heads of source files and whole licences, by SPDX identifier."""
    folder = Path(__file__).with_name("texts")
    return TEMPLATES + HEADERS + tuple((name, (folder / f"{name}.txt").read_text(encoding="utf-8")) for name in WHOLE)


def weights(templates, idf: dict[str, float]) -> list[dict[str, float]]:
    """Unit TF-IDF vectors of the templates."""
    out = []
    for _, text in templates:
        v = {w: (1 + math.log(n)) * idf[w] for w, n in Counter(words(text)).items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        out.append({w: x / size for w, x in v.items()})
    return out


def anchor_words(vectors, threshold: float) -> list[str]:
    """Words of which a text must hold one to reach ``threshold`` with any template.

    Without a template's anchors the rest of its unit vector is shorter than the threshold, and so is
    its cosine with any text.
    """
    out = set()
    for v in vectors:
        rest = 1.0
        for w, x in sorted(v.items(), key=lambda p: (-p[1], p[0])):
            if rest < threshold * threshold - 1e-9:
                break
            out.add(w)
            rest -= x * x
    return sorted(out)


def directory(path) -> Column:
    """The path up to its last slash, without it; empty at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def _parts(texts: DataFrame) -> DataFrame:
    """``(key, part, words, m)``, m being the number of different words: each line, each block between blank lines, and the whole of ``texts (key, text)``."""
    lines = texts.select("key", F.posexplode(F.split("text", "\n")).alias("part", "text"))
    blocks = texts.select("key", F.posexplode(F.split("text", BLOCK_BREAK)).alias("part", "text")).withColumn("part", -2 - F.col("part"))
    parts = lines.unionByName(blocks).unionByName(texts.select("key", F.lit(WHOLE_TEXT).alias("part"), "text"))
    return parts.select("key", "part", F.array_remove(F.split("text", WORD_BREAK), "").alias("words")).withColumn("m", F.size(F.array_distinct("words")))


def _weight():
    """1 + ln of a word's count."""
    return 1 + F.log(F.count("*").cast("double"))


def _least_squares(held: DataFrame, total: int) -> list[float]:
    """By number of words, the least sum of their squared inverse document frequencies: that of the most frequent ones."""
    common = held.orderBy(F.desc("n")).limit(COMMON).select("n").collect()
    return [0.0, *itertools.accumulate((math.log((1 + total) / (1 + r.n)) + 1) ** 2 for r in common)]


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if rows_below(df, BROADCAST_ROWS) else df


def own_licenses(texts: DataFrame, held: DataFrame, total: int, templates, threshold: float) -> DataFrame:
    """``(key, own_license, score, is_license_file)`` of those of the distinct ``texts (key, text)`` that have a license.

    ``held (w, n)`` counts the rows with each word, ``total`` all rows.
    """
    spark = texts.sparkSession
    vocabulary = sorted({w for _, t in templates for w in words(t)})
    # one row for each word of a template comes to the driver
    counts = {r.w: r.n for r in held.join(F.broadcast(_table(spark, [(w,) for w in vocabulary], "w string")), "w").collect()}
    vectors = weights(templates, {w: math.log((1 + total) / (1 + counts.get(w, 0))) + 1 for w in vocabulary})
    likely = texts.where(F.arrays_overlap(F.split("text", WORD_BREAK), F.array(*[F.lit(w) for w in anchor_words(vectors, threshold)])))
    likely = cut(likely.dropDuplicates(["key"]), "licenses")
    known = F.broadcast(_table(spark, [(w, k, v) for k, vector in enumerate(vectors) for w, v in vector.items()], "w string, k int, v double"))
    n_words = F.broadcast(_table(spark, [(w, (math.log((1 + total) / (1 + counts.get(w, 0))) + 1)) for w in vocabulary], "w string, idf double"))
    parts = _parts(likely)
    # only words of templates are counted at first; a part's other words weigh as much as the most frequent ones at least, which bounds its cosines
    shared = parts.select("key", "part", "m", F.explode("words").alias("w")).join(n_words, "w").repartition("key", "part")  # one exchange for both sums
    shared = shared.groupBy("key", "part", "m", "w", "idf").agg(_weight().alias("x"))
    shared = shared.select("key", "part", "m", "w", (F.col("x") * F.col("idf")).alias("x")).join(known, "w")
    shared = shared.groupBy("key", "part", "m", "k").agg(F.sum(F.col("x") * F.col("v")).alias("dot"), F.sum(F.col("x") * F.col("x")).alias("own"), F.count("*").alias("n"))
    least = F.array(*[F.lit(x) for x in _least_squares(held, total)])
    others = F.element_at(least, (F.least(F.col("m") - F.col("n"), F.size(least) - 1) + 1).cast("int"))
    can = cut(shared.where(F.col("dot") >= (threshold - 1e-9) * F.sqrt(F.col("own") + others)).select("key", "part", "k", "dot"), "licenses")
    # the whole vectors of the parts that are left
    some = can.select("key", "part").distinct()
    terms = cut(parts.join(_sent(some), ["key", "part"], "left_semi").select("key", "part", F.explode("words").alias("w")).groupBy("key", "part", "w").agg(_weight().alias("x")), "licenses")
    weight = cut(held.join(_sent(terms.select("w").distinct()), "w", "left_semi").select("w", (F.log((1.0 + total) / (1 + F.col("n"))) + 1).alias("idf")), "licenses")
    if rows_below(weight, BROADCAST_ROWS):
        terms = terms.join(F.broadcast(weight), "w")
    else:  # a word may be in many parts: they meet salted copies of its row
        weight = weight.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        terms = terms.withColumn("salt", F.pmod(F.xxhash64("key", "part"), F.lit(SALTS)).cast("int")).join(weight, ["w", "salt"])
    sizes = terms.groupBy("key", "part").agg(F.sqrt(F.sum(F.col("x") * F.col("idf") * F.col("x") * F.col("idf"))).alias("size"))
    scored = can.join(sizes, ["key", "part"]).select("key", "part", F.struct(F.round(F.col("dot") / F.col("size"), 6).alias("score"), (-F.col("k")).alias("k")).alias("best"))
    own = scored.where(F.col("best.score") >= threshold).groupBy("key").agg(F.max("best").alias("best"), F.max(F.col("part") == WHOLE_TEXT).alias("is_license_file"))
    names = F.array(*[F.lit(n) for n, _ in templates])
    return cut(own.select("key", F.element_at(names, 1 - F.col("best.k")).alias("own_license"), F.col("best.score").alias("score"), "is_license_file"), "licenses")


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from the driver, as a literal."""
    names = [f.split()[0] for f in schema.split(", ")]
    data = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.explode(F.from_json(F.lit(data), f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")).alias("r")).select("r.*")


def scan_licenses(files: DataFrame, templates=None, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, path, own_license, score, is_license_file, license, license_path)`` for every row of ``files (doc_id, path, text)``.

    Each line of a text, each block between blank lines (so the head of a source file, wherever it is) and the
    whole are compared with each template (short notices, heads of files and whole licences) by the cosine of
    TF-IDF vectors: 1 + ln of a word's count (words are runs of a-z, 0-9 after lower-casing) times
    ln((1 + N) / (1 + df)) + 1, df counting the rows whose text holds the word, of all N rows.
    own_license is the template of the best score of at least ``threshold`` (ties: the first
    template); score is that, rounded to 6 places, else null. A file is a license file if its whole
    text scores so. A file without a license of its own inherits that of the nearest directory, its
    own or one above, that holds a license file (of several the first path, then the first license by name);
    license_path names it, and is the row's own path where the license is its own; both are null where none is found. Null
    and empty texts have no license of their own. A row with null path has its own license, is in no
    directory and inherits nothing. Rows that repeat a path are files of their own. An empty table
    gives no rows. Other columns aren't read.
    """
    templates = templates or globals()["templates"]()
    rows = files.select("doc_id", "path", "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"))
    texts = rows.where("text is not null").select("key", F.lower("text").alias("text"))
    held = texts.select(F.explode(F.array_distinct(F.split("text", WORD_BREAK))).alias("w")).where("w <> ''")
    held = cut(held.groupBy("w").agg(F.count("*").alias("n")), "licenses")
    own = own_licenses(texts, held, rows.count(), templates, threshold)
    slim = rows.select("doc_id", "path", "key", directory("path").alias("dir"), F.pmod(F.xxhash64("path", "doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    if rows_below(own, BROADCAST_ROWS):
        slim = slim.join(F.broadcast(own), "key", "left")
    else:  # a text may have many copies: they meet salted copies of its row
        slim = slim.join(own.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), ["key", "salt"], "left")
    slim = cut(slim.drop("key"), "licenses")
    # nearest license of each directory: its ancestors meet the directories that hold a license file
    at = slim.where("is_license_file and path is not null").select(F.col("dir").alias("above"), F.struct("path", "own_license").alias("found")).groupBy("above").agg(F.min("found").alias("found"))
    dirs = slim.where("path is not null").select("dir").distinct()
    steps = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(steps))), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(steps, 1, n), "/").alias("above")))
    nearest = dirs.select("dir", F.explode(up).alias("u")).select("dir", "u.depth", "u.above").join(at, "above").groupBy("dir").agg(F.max_by("found", "depth").alias("found"))
    nearest = cut(nearest.select("dir", F.col("found.own_license").alias("inherited"), F.col("found.path").alias("inherited_from")), "licenses")
    if rows_below(nearest, BROADCAST_ROWS):
        out = slim.join(F.broadcast(nearest), "dir", "left")
    else:  # a directory may hold many files: they meet salted copies of its row
        out = slim.join(nearest.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), ["dir", "salt"], "left")
    return out.select(
        "doc_id", "path", "own_license", "score", F.coalesce("is_license_file", F.lit(False)).alias("is_license_file"),
        F.coalesce("own_license", "inherited").alias("license"), F.when(F.col("own_license").isNotNull(), F.col("path")).otherwise(F.col("inherited_from")).alias("license_path"),
    )
