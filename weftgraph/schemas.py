"""Schemas of the tables that operators take and give."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    return T._parse_datatype_string(text)  # needs a running session


PROVENANCE = "struct<source_type:string,ref:string,confidence:string,created_at:string,reviewed_by:string>"
ENTITY = (
    "id string, type string, name_zh string, name_en string, domain string, description string, parameters array<string>, metrics array<string>, "
    "equipment array<string>, materials array<string>, stage string, unit string, typical_range string, severity string, steps array<string>, "
    "economic_hooks struct<affects:array<string>,note:string>, tags array<string>, aliases array<string>, attributes map<string,string>, "
    f"provenance {PROVENANCE}, _file string, _ord long"
)
EDGE = f"src string, rel_type string, dst string, note string, confidence string, likelihood string, derived boolean, field string, provenance {PROVENANCE}, _file string, _ord long"
CASE = (
    "id string, domain string, title string, anomaly_ref string, detected_at_ref string, severity string, symptoms array<string>, "
    "possible_causes array<struct<cause_ref:string,likelihood:string,discriminator:string>>, detection array<struct<metric_ref:string,signal:string>>, "
    "actions array<struct<action_ref:string,condition:string,`order`:int>>, impact struct<blocked_processes:array<string>,economic:string>, "
    f"tags array<string>, notes string, provenance {PROVENANCE}, _file string, _ord long"
)
#: o_dt and o_lang are empty where the object has none, so that rows compare without null rules.
QUAD = "g string, s string, p string, o string, o_kind string, o_dt string, o_lang string"
TRIPLE = QUAD.removeprefix("g string, ")
TRIPLE_COLUMNS = ["s", "p", "o", "o_kind", "o_dt", "o_lang"]
VIOLATION = "severity string, rule string, subject string, detail string, _file string"


def struct(text: str) -> T.StructType:
    return _struct(text)
