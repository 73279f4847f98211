"""Weights and keys of the ranking stages as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights by trust and zone, relation families.
TRUST = {"trusted": 1.0, "derived": 0.95, "untrusted": 0.85}
UNKNOWN_TRUST = 0.85
ZONE = {"wiki": 1.0, "output": 0.7, "incoming": 0.8}
DISTILLED = 0.87
ENTITY = 1.5
TIE = 1e-9
FAMILIES = {
    "structural": ["contains", "part-of", "instance-of", "has-instance", "subtype-of", "supertype-of", "implements", "implemented-by", "composed-of", "component-of"],
    "dependency": ["depends-on", "dependency-of", "requires", "required-by", "uses", "used-by", "extends", "extended-by", "wraps", "wrapped-by"],
    "epistemic": ["supports", "supported-by", "contradicts", "contradicted-by", "refines", "refined-by", "qualifies", "qualified-by", "derived-from", "source-of", "cites", "cited-by"],
    "temporal": ["precedes", "succeeds", "supersedes", "superseded-by", "co-occurs-with", "valid-from", "valid-until", "observed-at"],
    "causal": ["causes", "caused-by", "enables", "enabled-by", "blocks", "blocked-by", "triggers", "triggered-by", "solves", "solved-by", "competes-with", "complements"],
}


def zone(path: Column) -> Column:
    """incoming, output or wiki, by the folders of a path; the file name doesn't count."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    first = F.try_element_at(folders, F.lit(1))
    some = lambda prefix: F.exists(folders, lambda x: x.startswith(prefix))
    return F.when((first == "raw") | some("in_"), "incoming").when((first == "out") | some("out_"), "output").otherwise("wiki")


def trust_weight(trust: Column) -> Column:
    w = F.lit(UNKNOWN_TRUST)
    for name, value in TRUST.items():
        w = F.when(trust == name, value).otherwise(w)
    return w


def zone_weight(path: Column) -> Column:
    z = zone(path)
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.when(z == "output", F.when(F.array_contains(folders, "out_distill"), DISTILLED).otherwise(ZONE["output"])).when(z == "incoming", ZONE["incoming"]).otherwise(ZONE["wiki"])


def entity_weight(query: Column, title: Column, ident: Column) -> Column:
    q = F.lower(F.trim(query))
    last = F.lower(F.element_at(F.split(ident, "/"), -1))
    same = (q != "") & ((q == F.lower(F.trim(F.coalesce(title, F.lit(""))))) | (q == last))
    return F.when(F.coalesce(same, F.lit(False)), ENTITY).otherwise(1.0)


def family(kind: Column) -> Column:
    """Family of a normalised relation type; structural if unknown."""
    out = F.lit("structural")
    for name, kinds in FAMILIES.items():
        if name != "structural":
            out = F.when(kind.isin(kinds), name).otherwise(out)
    return out
