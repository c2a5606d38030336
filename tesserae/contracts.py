"""Schemas of the values that operators exchange."""

from __future__ import annotations

DIAGNOSTIC = "struct<severity:string,category:string,message:string>"
POLICY = "struct<surface:string,name:string>"
OWNER = "struct<ord:int,path:string,owner_kind:string,match_key:string,level:int,info_string:string>"
SURFACE = (
    "struct<surface_kind:string,declared_language:string,effective_language:string,address:string,parent_address:string,"
    "owner_kind:string,owner_address:string,start_line:int,end_line:int,reconstruction_strategy:string,family:string,comment_prefix:string>"
)
ANALYSIS = (
    f"struct<ok:boolean,diagnostics:array<{DIAGNOSTIC}>,kind:string,dialect:string,allows_comments:boolean,"
    f"normalized_source:string,root_kind:string,owners:array<{OWNER}>,surfaces:array<{SURFACE}>>"
)
MERGE_RESULT = f"struct<ok:boolean,diagnostics:array<{DIAGNOSTIC}>,output:string,policies:array<{POLICY}>>"

DESTINATION_WINS = {"surface": "array", "name": "destination_wins_array"}
TRAILING_COMMA = {"surface": "fallback", "name": "trailing_comma_destination_fallback"}


def diagnostic(category: str, message: str, severity: str = "error") -> dict:
    return {"severity": severity, "category": category, "message": message}


def failure(category: str, message: str) -> dict:
    return {"ok": False, "diagnostics": [diagnostic(category, message)]}
