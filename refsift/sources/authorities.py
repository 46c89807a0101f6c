"""Records of bibliographic authorities as tables, and snapshots of their answers.

Answers are snapshots with a status (hit, miss, unreachable), so a plan never
waits for a network. fetch() makes a snapshot where one is wanted.
"""
from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col, from_inverted, markup_text

RESPONSE = "url string, status string, code int, body binary, cached_at string"
_PERSON = "struct<family:string,given:string,name:string>"
_DATE = "struct<`date-parts`:array<array<int>>>"
CROSSREF = f"""struct<message:struct<DOI:string,title:array<string>,author:array<{_PERSON}>,issued:{_DATE},`published-print`:{_DATE},`published-online`:{_DATE},
    published:{_DATE},type:string,abstract:string,reference:array<struct<DOI:string,`article-title`:string,author:string,year:string>>>>"""
OPENALEX = """struct<id:string,doi:string,title:string,display_name:string,publication_year:int,type:string,abstract_inverted_index:map<string,array<int>>,
    authorships:array<struct<author:struct<display_name:string>>>,primary_location:struct<source:struct<display_name:string>>>"""
ATOM = "struct<entry:array<struct<id:string,title:string,published:string,summary:string,author:array<struct<name:string>>>>>"
#: Attempts at a request, and seconds between those to one host, or by default.
ATTEMPTS, TIMEOUT, PACE, PACES = 3, 20, 0.12, {"export.arxiv.org": 3.5, "en.wikipedia.org": 0.25}


def crossref(body: Column | str) -> Column:
    """A Crossref answer as doi, title, authors, year, type and abstract; null if it has no work."""
    m = F.from_json(col(body).cast("string"), CROSSREF)["message"]
    year = F.coalesce(*[F.try_element_at(F.try_element_at(m[k]["date-parts"], F.lit(1)), F.lit(1)) for k in ("published-print", "published-online", "published", "issued")])
    names = F.filter(F.transform(m["author"], lambda a: F.coalesce(a["family"], a["name"])), lambda n: n.isNotNull())
    work = F.struct(F.lower(m["DOI"]).alias("doi"), F.try_element_at(m["title"], F.lit(1)).alias("title"), names.alias("authors"), year.alias("year"), m["type"].alias("type"), markup_text(m["abstract"]).alias("abstract"))
    return F.when(m["DOI"].isNotNull(), work)


def openalex(body: Column | str) -> Column:
    r = F.from_json(col(body).cast("string"), OPENALEX)
    surnames = F.transform(r["authorships"], lambda a: F.element_at(F.split(a["author"]["display_name"], r"\s+"), -1))
    work = F.struct(
        F.lower(F.regexp_replace(r["doi"], "(?i)^https?://(dx\\.)?doi\\.org/", "")).alias("doi"), F.coalesce(r["title"], r["display_name"]).alias("title"), surnames.alias("authors"),
        r["publication_year"].alias("year"), r["type"].alias("type"), r["primary_location"]["source"]["display_name"].alias("venue"), from_inverted(r["abstract_inverted_index"]).alias("abstract"),
    )
    return F.when(r["id"].isNotNull(), work)


def arxiv(body: Column | str) -> Column:
    """The first entry of an arXiv feed; null if there is none, or if it reports an error."""
    e = F.try_element_at(F.from_xml(col(body).cast("string"), ATOM, {"rowTag": "feed"})["entry"], F.lit(1))
    number = F.regexp_replace(F.regexp_extract(e["id"], r"abs/(.*)$", 1), r"v\d+$", "")
    work = F.struct(
        number.alias("arxiv_id"), F.trim(F.regexp_replace(e["title"], r"\s+", " ")).alias("title"), F.transform(e["author"], lambda a: F.element_at(F.split(F.trim(a["name"]), r"\s+"), -1)).alias("authors"),
        F.substring(e["published"], 1, 4).try_cast("int").alias("year"), F.trim(e["summary"]).alias("abstract"),
    )
    return F.when(e["id"].isNotNull() & (F.trim(e["title"]) != "Error") & (number != ""), work)


class Getter:
    """Asks for an address: status, code and body.

    404 is a miss; what is busy, slow or broken is tried again and then
    unreachable, as is any other refusal. With alive, only whether a link answers is asked: by
    HEAD, and by GET where a server doesn't serve HEAD (403, 405, 406) or doesn't answer it.
    """

    def __init__(self, timeout: float = TIMEOUT, mailto: str | None = None, attempts: int = ATTEMPTS, alive: bool = False, open=urllib.request.urlopen, pause=time.sleep):
        self.timeout, self.attempts, self.alive, self.open, self.pause = timeout, attempts, alive, open, pause
        self.agent = "refsift" + (f" (mailto:{mailto})" if mailto else "")

    def __call__(self, url: str) -> tuple[str, int | None, bytes | None]:
        if not self.alive:
            return self._ask(url, "GET")
        status, code, _ = self._ask(url, "HEAD")
        if code in (403, 405, 406) or code is None:
            status, code, _ = self._ask(url, "GET")
        return "miss" if code is not None and 400 <= code < 500 and code != 429 else status, code, None

    def _ask(self, url: str, method: str) -> tuple[str, int | None, bytes | None]:
        code = None
        for attempt in range(self.attempts):
            if attempt:
                self.pause(2.0 ** (attempt - 1))
            try:
                with self.open(urllib.request.Request(url, method=method, headers={"User-Agent": self.agent}), timeout=self.timeout) as answer:  # noqa: S310
                    return "hit", answer.status, answer.read()
            except urllib.error.HTTPError as e:
                code = e.code
                if code == 404:
                    return "miss", code, None
                if code != 429 and code < 500:
                    break
            except (OSError, ValueError):
                code = None
        return "unreachable", code, None


def fetch(urls: DataFrame, known: DataFrame, get: Callable[[str], tuple] | None = None, workers: int = 1) -> DataFrame:
    """Answers (RESPONSE) for urls (url) that known answers lack.

    A host is asked by so many tasks at once, each at so many times the host's pace, so that it gets no more requests a second
    however long each takes. Server errors aren't part of the answer, so they are asked again next time.
    """
    get = get or Getter()
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    asked = urls.select("url").distinct().join(known.where("status <> 'unreachable'").select("url"), "url", "left_anti").withColumn("host", host)
    asked = asked.withColumn("shard", F.pmod(F.xxhash64("url"), F.lit(workers)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[tuple, float] = {}
        for frame in frames:
            rows = []
            for url, *key in zip(frame["url"], frame["host"], frame["shard"]):
                time.sleep(max(0.0, last.get(tuple(key), 0.0) + workers * PACES.get(key[0], PACE) - time.monotonic()))
                status, code, body = get(url)
                last[tuple(key)] = time.monotonic()
                rows.append((url, status, code, body, datetime.now(timezone.utc).isoformat(timespec="seconds")))
            yield pd.DataFrame(rows, columns=["url", "status", "code", "body", "cached_at"])

    return asked.repartition("host", "shard").mapInPandas(run, RESPONSE)


def cached(spark: SparkSession, urls: DataFrame, folder: str | None, get: Callable[[str], tuple], workers: int = 1) -> DataFrame:
    """Answers for urls, from a folder that outlives the run and, where it lacks them, from fetch(), which are added to it. No folder: nothing is kept."""
    known = spark.createDataFrame([], RESPONSE)
    if not folder:
        return fetch(urls, known, get, workers).cache()
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)
    known = spark.read.schema(RESPONSE).parquet(folder) if there else known
    fetch(urls, known, get, workers).write.mode("append").parquet(folder)
    answers = spark.read.schema(RESPONSE).parquet(folder)
    # What couldn't be reached before may have been reached since.
    latest = answers.groupBy("url").agg(F.max_by(F.struct("status", "code", "body", "cached_at"), F.struct(F.col("status") != "unreachable", "cached_at")).alias("a"))
    return latest.select("url", "a.*").join(urls.select("url").distinct(), "url", "left_semi")


ADDRESSES = {"crossref": "https://api.crossref.org/works/", "openalex": "https://api.openalex.org/works/doi:", "arxiv": "https://export.arxiv.org/api/query?id_list="}


def snapshots(spark: SparkSession, citations: DataFrame, folder: str | None, get: Getter, workers: int = 1, urls: bool = True) -> dict[str, DataFrame]:
    """Tables for a Verifier (first, second, arxiv, urls) of what citations name, asked from the authorities themselves.

    An answer that holds no record is a miss. The second authority is asked about what the first lacks.
    """
    name = lambda kind: citations.where(F.col("kind") == kind).select("identifier").where("identifier is not null").distinct()
    at = lambda rows, authority: rows.withColumn("url", F.concat(F.lit(ADDRESSES[authority]), F.replace(F.url_encode("identifier"), F.lit("%2F"), F.lit("/"))))

    def records(rows: DataFrame, authority: str, parse: Callable[[Column], Column], key: str) -> DataFrame:
        asked = at(rows, authority)
        answers = cached(spark, asked, folder, get, workers).withColumn("r", parse(F.col("body")))
        status = F.when((F.col("status") == "hit") & F.col("r").isNull(), "miss").otherwise(F.col("status"))
        return asked.join(answers.select("url", status.alias("status"), "r"), "url").select(F.col("identifier").alias(key), "status", "r.title", "r.authors", "r.year")

    first = records(name("doi"), "crossref", crossref, "doi")
    rest = first.where("status = 'miss'").select(F.col("doi").alias("identifier"))
    found = {"first": first, "second": records(rest, "openalex", openalex, "doi"), "arxiv": records(name("arxiv").select(F.regexp_replace("identifier", r"v\d+$", "").alias("identifier")).distinct(), "arxiv", arxiv, "arxiv_id")}
    if urls:
        live = Getter(get.timeout, None, get.attempts, True, get.open, get.pause)
        live.agent = get.agent
        links = name("url").select(F.col("identifier").alias("url"))
        # Apart from records: whether a link answers says nothing of its content.
        found["urls"] = cached(spark, links, folder and f"{folder.rstrip('/')}-links", live, workers).select("url", "status")
    return found


def sample(rows: DataFrame, by: str, per_group: int, key: str, seed: int = 42) -> DataFrame:
    """So many rows of each group, by a hash of key and seed: the same ones whatever the order of the input."""
    from pyspark.sql import Window

    rank = Window.partitionBy(by).orderBy(F.xxhash64(key, F.lit(seed)), key)
    return rows.withColumn("nth", F.row_number().over(rank)).where(F.col("nth") <= per_group).drop("nth")
