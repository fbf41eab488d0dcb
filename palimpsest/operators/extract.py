"""Text to facts: a vocabulary of predicates, entities, relations between neighbours, aliases, observations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import scoring as S
from palimpsest.operators import episodes as E
from palimpsest.operators.order import numbered

# Canonical predicates and the surface forms that mean them.
SURFACES = {
    "recommends": ["recommended", "suggested", "told me about", "pitched", "mentioned to me"],
    "located_in": ["in", "based in", "is from", "lives in", "is located in"],
    "works_at": ["works at", "is employed by", "is at", "works for"],
    "likes": ["likes", "loves", "prefers", "is into", "enjoys"],
    "said": ["said", "told", "claimed", "mentioned"],
    "met": ["met", "ran into", "saw", "encountered"],
    "visited": ["visited", "went to", "stopped by", "dropped in at"],
    "owns": ["owns", "has", "possesses"],
    "chose": ["chose", "selected", "picked", "opted for"],
    "avoided": ["avoided", "declined", "skipped"],
    "introduced": ["introduced", "presented", "brought up"],
    "arrived_at": ["arrived at", "got to", "made it to", "reached"],
    "wrote": ["wrote", "authored", "drafted", "composed"],
    "discussed": ["discussed", "talked about", "chatted about"],
    "bought": ["bought", "purchased", "acquired"],
    "sold": ["sold", "traded"],
    "founded": ["founded", "established"],
    "knows": ["knows", "is acquainted with"],
    "hired": ["hired", "recruited"],
    "married": ["married", "is married to"],
    "thanked": ["thanked"],
    "praised": ["praised"],
}
# Confidence of a relation, most words between two entities, kinds and threshold of the entity finder.
RELATION_CONFIDENCE, MAX_BETWEEN = 0.5, 8
ENTITY_TYPES, ENTITY_THRESHOLD = ["person", "organization", "location", "product", "event"], 0.3
ALIAS_DISTANCE = 3

Entity = tuple[int, int, str]
ENTITIES = "array<struct<start:int,end:int,text:string>>"
TRIPLES = "array<struct<subject:string,predicate:string,object:string,confidence:double>>"


@dataclass
class ExtractorConfig:
    """Settings of the default extractor; `synonyms` maps surface forms to canonical predicates and wins over the built-in ones."""

    entity_types: list[str] = field(default_factory=lambda: list(ENTITY_TYPES))
    threshold: float = ENTITY_THRESHOLD
    synonyms: dict[str, str] = field(default_factory=dict)

    def surfaces(self) -> dict[str, str]:
        table = {s: p for p, ss in SURFACES.items() for s in ss}
        return table | {k.lower(): v for k, v in self.synonyms.items()}


def predicate_table(spark: SparkSession, synonyms: dict[str, str] | None = None) -> DataFrame:
    """(surface, predicate): the vocabulary with a deployment's own synonyms."""
    return spark.createDataFrame(sorted(ExtractorConfig(synonyms=synonyms or {}).surfaces().items()), "surface string, predicate string")


def canonical_predicates(df: DataFrame, table: DataFrame, column: str = "surface") -> DataFrame:
    """Adds `predicate`: the canonical form of a surface form in any case, null if unknown."""
    return df.join(F.broadcast(table.withColumnRenamed("surface", "_s")), F.lower(F.col(column)) == F.col("_s"), "left").drop("_s")


#: What ends a sentence.
STOP = "[.!?]"


def sentences(text: Column | str) -> Column:
    """The sentences of a text with their end marks, without white space around them; an empty text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.transform(F.split(text, f"(?<={STOP})"), lambda s: F.trim(s)), lambda s: s != "")


def find_entities(text: str) -> list[Entity]:
    """The default entity finder: runs of capitalised words, those that only begin a sentence in common use left out."""
    found = []
    for m in regex.finditer(r"(?<!\w)\p{Lu}[\w'’-]*(?:[ ](?=\p{Lu})[\w'’-]+)*", text):
        body = m.group().rstrip("'’-")
        if body.lower() not in _COMMON:
            found.append((m.start(), m.start() + len(body), body))
    return found


_COMMON = set("a an and at but did for from he her his i if in is it its my no not of on or our please she so that the their then there they this to was we what when where who why you your".split())


def relations(text: Column, entities: Column, surfaces: dict[str, str]) -> Column:
    """Facts between neighbouring entities of one sentence: the phrase between them that is a known surface, else its first word that is.

    text is a string, entities an array<struct<start,end,text>> of places in it; the result is an array of TRIPLES,
    empty for null texts. All of it is one expression: only the entity finder may need Python.
    """
    known = F.create_map(*(F.lit(x) for kv in sorted(surfaces.items()) for x in kv)) if surfaces else F.create_map().cast("map<string,string>")
    ordered = F.array_sort(entities)
    last = F.greatest(F.size(ordered) - 1, F.lit(0))

    def between(a: Column, b: Column) -> Column:
        """What stands between two entities, with the words looked up in turn: the whole phrase first."""
        said = F.substring(text, a["end"] + 1, F.greatest(b["start"] - a["end"], F.lit(0)))
        stops = F.substring(text, a["start"] + 1, b["start"] - a["start"]).rlike(STOP)
        words = F.filter(F.split(said, r"\s+"), lambda w: w != "")
        looked_up = F.concat(F.array(F.lower(F.trim(said))), F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}]+|[^\p{L}]+$", ""))))
        found = F.filter(F.transform(looked_up, lambda w: F.try_element_at(known, w)), lambda p: p.isNotNull())
        fits = ~stops & (F.size(words) > 0) & (F.size(words) <= MAX_BETWEEN)
        return F.struct(a["text"].alias("subject"), F.when(fits, F.get(found, F.lit(0))).alias("predicate"), b["text"].alias("object"), F.lit(RELATION_CONFIDENCE).alias("confidence"))

    facts = F.zip_with(F.slice(ordered, 1, last), F.slice(ordered, 2, last), between)
    return F.coalesce(F.filter(facts, lambda f: f["predicate"].isNotNull()), F.array()).cast(TRIPLES)


def extractor(config: ExtractorConfig | None = None, finder: Callable[[str], list[Entity]] = find_entities) -> Callable[[Column | str], Column]:
    """text -> triples: any entity finder can be plugged in and runs on Arrow batches; null texts give no facts.

    A finder gives (start, end, text), or (start, end, text, kind, score) to be held against the kinds and the
    threshold of the configuration.
    """
    config = config or ExtractorConfig()
    kinds, threshold = frozenset(config.entity_types), config.threshold

    @F.pandas_udf(ENTITIES)
    def entities(texts: pd.Series) -> pd.Series:
        keep = lambda e: len(e) < 5 or (e[3] in kinds and e[4] >= threshold)
        return texts.map(lambda t: [dict(zip(("start", "end", "text"), e)) for e in finder(t) if keep(e)] if t else [])

    surfaces = config.surfaces()
    return lambda text: relations(F.col(text) if isinstance(text, str) else text, entities(text), surfaces)


def null_extractor() -> Callable[[Column], Column]:
    """Extractor that finds nothing: observations stay text only."""
    return lambda text: F.array().cast(TRIPLES)


def resolve_aliases(mentions: DataFrame, concepts: DataFrame, distance: int = ALIAS_DISTANCE) -> DataFrame:
    """(name, concept_id, how): existing concepts by lower case, else a single one within an edit distance, else new ones.

    A batch is resolved against the concepts stored before it; mentions that differ in case only share one new
    concept, numbered in order of name after the largest id.
    """
    one = mentions.filter("name is not null").select("name").distinct()
    known = E.concept_lookup(one, concepts, distance)
    rest = one.join(known, "name", "left_anti").withColumn("l", F.lower("name"))
    start = concepts.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).scalar()
    fresh = numbered(rest.select("l").distinct(), ["l"], "nth", 1).withColumn("concept_id", (F.col("nth") + start).cast("long"))
    return known.unionByName(rest.join(fresh, "l").select("name", "concept_id", F.lit("new").alias("how")))


def observe(texts: DataFrame, now: Column, first_id: int, extract, source: str = "unknown", session: str | None = None) -> DataFrame:
    """Episodes from (pos, text, [observed_at]): facts, valid time from a time anchor or the observation, confidence.

    Confidence is the geometric mean of the facts' confidences, 0.5 without facts. Ids follow `pos`.
    """
    at = F.coalesce("observed_at", now) if "observed_at" in texts.columns else now
    x = numbered(texts, ["pos"], "id", first_id).withColumn("triples", extract(F.col("text"))).withColumn("at", at).withColumn("anchor", S.time_anchor(F.col("text"), F.col("at")))
    logs = F.aggregate(F.filter("triples", lambda t: t["confidence"] > 0), F.lit(0.0), lambda s, t: s + F.log(t["confidence"]))
    positive = F.size(F.filter("triples", lambda t: t["confidence"] > 0))
    none = F.lit(None).cast("string")
    provenance = F.struct(F.lit(source).alias("source"), F.lit(session).cast("string").alias("session_id"), none.alias("trace_id"), F.create_map().cast("map<string,string>").alias("metadata"))
    return x.select(
        F.col("id").cast("long").alias("id"), "text", "triples",
        F.coalesce("anchor.start", "at").alias("valid_start"), F.col("anchor.end").alias("valid_end"), now.alias("t_tx_start"), provenance.alias("provenance"),
        F.when(positive > 0, F.exp(logs / positive)).otherwise(0.5).alias("confidence"), F.lit(None).cast("long").alias("superseded_by"),
    )
