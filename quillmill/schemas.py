"""Explicit schemas of the tables that operators exchange."""

ELEMENTS = "doc_id bigint, seq bigint, type string, element_id string, footnote_id string, text string, empty boolean"
BLOCKS = "doc_id bigint, page int, ord int, x0 double, y0 double, x1 double, y1 double, text string"
CHANGES = "doc_id bigint, change_no bigint, type string, element_id string, footnote_id string, page int, line int, old string, new string, motivation string"
REPLIES = "doc_id bigint, chunk_id int, ok boolean, raw string"
SEGMENTS = "array<struct<ord:int,kind:string,val:string>>"
ANNOTATIONS = "doc_id bigint, page int, ord int, x0 double, y0 double, x1 double, y1 double, content string"
PARTS = "path string, part_name string, content binary, error string"
RUNS = "doc_id bigint, part_name string, para_no int, run_no int, color string, strike boolean, text string, comment_ref string, footnote_ref string"
JOB_EVENTS = "job_id bigint, seq bigint, status string, done boolean, error string"
PDF_STRUCTURE = "doc_id bigint, type string, pages array<struct<page:int,lines:array<struct<line:int,text:string>>>>"
DOCX_STRUCTURE = "doc_id bigint, type string, elements array<struct<type:string,element_id:string,footnote_id:string,text:string,empty:boolean>>"
#: One change as a reply spells it; everything is text until it is checked.
REPLY_ITEMS = "array<struct<type:string,element_id:string,footnote_id:string,page:string,line:string,old:string,new:string,motivation:string>>"
