"""Records from article XML, and from a remote archive by search and fetch."""

from __future__ import annotations

import io
import time
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from halyard.sources.tables import RECORD

#: Element and attribute names of the archive's replies.
ARTICLE, BOOK = "PubmedArticle", "PubmedBookArticle"
ID, TITLE, JOURNAL, ABSTRACT = "PMID", "ArticleTitle", "Journal/Title", "AbstractText"
YEAR, LOOSE_DATE = "JournalIssue/PubDate/Year", "JournalIssue/PubDate/MedlineDate"
LANGUAGE, TYPE, HEADING, MAJOR = "Language", "PublicationTypeList/PublicationType", "MeshHeading/DescriptorName", "MajorTopicYN"
BOOK_ID = "BookDocument/PMID"


class _Fields:
    """What one item of a reply has said so far; elements are told as they end, with their path and text."""

    #: Path endings whose first text counts, and endings whose texts make a list.
    FIRST = {ID: "pmid", TITLE: "title", JOURNAL: "journal", YEAR: "issue_year", LOOSE_DATE: "loose_date", BOOK_ID: "book_id"}
    EACH = {ABSTRACT: "abstract", LANGUAGE: "languages", TYPE: "publication_types", HEADING: "mesh_major"}

    def __init__(self):
        self.first: dict[str, str] = {}
        self.each: dict[str, list[str]] = {name: [] for name in self.EACH.values()}

    def tell(self, path: list[str], text: str, attributes: dict[str, str]) -> None:
        for size in (1, 2, 3):
            ending = "/".join(path[-size:])
            if name := self.FIRST.get(ending):
                self.first.setdefault(name, text)
            if (name := self.EACH.get(ending)) and text and (name != "mesh_major" or attributes.get(MAJOR) == "Y"):
                self.each[name].append(text)

    def article(self) -> dict:
        """A record; its year is the issue's, else the first four digits of the loose date."""
        digits = [c for c in self.first.get("loose_date", "") if c.isdigit()]
        year = self.first.get("issue_year", "".join(digits[:4]))
        simple = {name: self.first.get(name, "") for name in ("pmid", "title", "journal")}
        return simple | self.each | {"abstract": " ".join(self.each["abstract"]), "year": year if year.isdigit() else None}

    def book(self) -> dict:
        if not self.first.get("book_id"):
            raise ValueError("book without an id")
        return {"pmid": self.first["book_id"], "record_type": BOOK, "exclusion": "books are no articles"}


def records_of(xml: str) -> Iterator[dict]:
    """Records of a reply, in order; books carry why they are left out; any other element is an error.

    The reply is read once, element by element: an item is dropped as soon as
    its record is made, so a reply of any length holds one item at a time.
    """
    path: list[str] = []
    fields = _Fields()
    for event, node in ET.iterparse(io.BytesIO(xml.encode()), events=("start", "end")):
        if event == "start":
            path.append(node.tag)
            if len(path) == 2:
                if node.tag not in (ARTICLE, BOOK):
                    raise ValueError(f"unexpected element {node.tag}")
                fields = _Fields()
            continue
        if len(path) > 2:
            fields.tell(path[2:], "".join(node.itertext()).strip(), node.attrib)
        elif len(path) == 2:
            yield fields.article() if node.tag == ARTICLE else fields.book()
            node.clear()
        path.pop()


def parse_replies(replies: DataFrame, column: str = "xml") -> DataFrame:
    """Records of a column of replies."""
    names = RECORD.names

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for xml in pdf[column]:
                yield pd.DataFrame([[r.get(n) for n in names] for r in records_of(xml)], columns=names)

    return replies.select(column).mapInPandas(run, RECORD)


def strip_markup(html):
    """Column: text without scripts, styles, comments and tags, white space joined."""
    t = F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def ids_of(reply: dict) -> list[str]:
    """Ids of a search reply; an error anywhere in it, a cut, a repeat or nothing is refused."""
    result = reply.get("esearchresult") or {}
    faults = [part[name] for part in (reply, result) for name in part if name.lower() in ("error", "errorlist") and part[name]]
    if faults or not isinstance(result.get("idlist"), list):
        raise ValueError(f"search failed: {faults or 'no ids'}")
    ids = list(map(str, result["idlist"]))
    if int(result.get("count", -1)) != len(ids) or len(ids) != len(set(ids)) or not ids:
        raise ValueError("search is empty, repeats ids or was cut off")
    return ids


def check_raw(searches: list[tuple[dict, list[str]]], replies: DataFrame, archive: DataFrame, column: str = "xml") -> DataFrame:
    """One row (queries, replies, records, excluded) if raw replies still make what is archived, else an error.

    ``searches`` are search replies with the ids that are archived of each,
    ``replies`` hold raw XML, ``archive`` the records.  Records are compared as
    a bag, with all their columns, wherever they lie.
    """
    for number, (reply, ids) in enumerate(searches):
        if ids_of(reply) != list(map(str, ids)):
            raise ValueError(f"search {number} differs from its archived ids")
    made, kept = parse_replies(replies, column), archive.select(*RECORD.names)
    for one, other, fault in ((made, kept, "not archived"), (kept, made, "not in the replies")):
        extra = one.exceptAll(other).first()
        if extra is not None:
            raise ValueError(f"record {extra['pmid']} is {fault}")
    counts = kept.agg(F.count("*").alias("records"), F.count_if(F.col("exclusion").isNotNull()).cast("long").alias("excluded"))
    return counts.select(F.lit(len(searches)).cast("long").alias("queries"), F.lit(replies.count()).cast("long").alias("replies"), "records", "excluded")


def patiently(call: Callable, tries: int = 5, pause: float = 0.34, sleep: Callable[[float], None] = time.sleep):
    """call(), throttled; tried again after 1, 2, 4, ... s if it may pass: too many requests, a server's or the net's fault."""
    for attempt in range(tries):
        sleep(pause)
        try:
            return call()
        except Exception as error:
            code = getattr(error, "code", None)
            passing = code == 429 or (isinstance(code, int) and code >= 500) or (code is None and isinstance(error, OSError))
            if not passing or attempt == tries - 1:
                raise
            sleep(2.0**attempt)
    raise AssertionError


class _Batch(InputPartition):
    def __init__(self, ids: list[str]):
        self.ids = ids


class _Reader(DataSourceReader):
    """Ids are fetched in batches by one partition after another's pace: the archive limits requests, not Spark."""

    def __init__(self, transport, term: str, size: int):
        self.transport, self.term, self.size = transport, term, size

    def partitions(self) -> list[InputPartition]:
        return [_Batch(patiently(lambda: self.transport.search(self.term)))]

    def read(self, partition: _Batch) -> Iterator[tuple]:
        for at in range(0, len(partition.ids), self.size):
            batch = partition.ids[at : at + self.size]
            found = {r["pmid"]: r for r in records_of(patiently(lambda batch=batch: self.transport.fetch(batch)))}
            if missing := set(batch) - set(found):
                raise ValueError(f"not returned: {sorted(missing)}")
            for i in batch:
                yield tuple(found[i].get(n) for n in RECORD.names)


def remote_records(spark: SparkSession, transport, term: str, batch: int = 200) -> DataFrame:
    """Records that a remote search finds.  ``transport`` has search(term) -> ids and fetch(ids) -> xml, and can be pickled."""

    class Archive(DataSource):
        @classmethod
        def name(cls) -> str:
            return "halyard_archive"

        def schema(self):
            return RECORD

        def reader(self, schema) -> DataSourceReader:
            return _Reader(transport, term, batch)

    spark.dataSource.register(Archive)
    return spark.read.format("halyard_archive").load()
