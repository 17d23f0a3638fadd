"""Spark schemas and enumerations of the document model: document, page, block, line, span, and the label tables."""

from __future__ import annotations

#: Names on the wire.
BLOCK_TYPES = ("title", "section_title", "paragraph", "caption", "table", "equation", "reference", "header", "footer", "unknown")
RETAINED_TYPES = ("reference", "equation", "table", "header", "footer")
STATUSES = ("pending", "translated", "retained", "failed", "demo")
ORIGINS = ("none", "provider", "cache", "resume", "retained", "demo")
LAYOUTS = ("single_column", "two_column", "uncertain")
TOKEN_KINDS = ("LITERAL", "MATH", "CIT", "REF", "PERCENT", "UNIT", "SYMBOL", "VAR", "NUM")
VERDICTS = ("not_reviewed", "pass", "minor_error", "major_error", "unusable")

BBOX = "x0 double, y0 double, x1 double, y1 double"
SPAN = f"text string, bbox struct<{BBOX.replace(' double', ':double')}>, font_size double, font_name string, flags int"
ITEM = "struct<placeholder:string,kind:string,value:string,start:int,end:int>"
ERROR = "struct<type:string,source:string,translation:string,message:string>"
CHECK = f"struct<passed:boolean,risk_score:double,errors:array<{ERROR}>>"
EXPLANATION = "struct<original:string,translation:string,plain_explanation:string,role_in_paper:string,key_terms:array<struct<term:string,explanation:string>>,warning:string>"

#: The document tree as JSON files hold it; version 0.1 files lack what 0.2 added, which reads as null and gets defaults.
BLOCK_JSON = (
    "struct<document_id:string,page:int,block_id:string,block_type:string,bbox:array<double>,section:string,source:string,text:string,confidence:double,"
    "lines:array<struct<text:string,bbox:array<double>,spans:array<struct<text:string,bbox:array<double>,font_size:double,font_name:string,flags:int>>,direction:array<double>>>,"
    f"native_block_number:int,protected_items:array<{ITEM}>,protected_text:string,raw_translation:string,translation:string,translation_status:string,translation_origin:string,"
    f"warnings:array<string>,check:{CHECK},explanation:{EXPLANATION}>"
)
PAGE_JSON = f"struct<page:int,width:double,height:double,requires_ocr:boolean,layout:string,warnings:array<string>,blocks:array<{BLOCK_JSON}>>"
STATS_JSON = "struct<provider_calls:int,cache_hits:int,resumed_blocks:int,retained_blocks:int,failed_blocks:int>"
DOCUMENT_JSON = f"schema_version string, document_id string, filename string, title string, target_language string, model string, mode string, status string, warnings array<string>, processing {STATS_JSON}, pages array<{PAGE_JSON}>"
CACHE = "key string, schema_version int, raw_translation string"
