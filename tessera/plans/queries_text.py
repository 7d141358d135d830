"""Queries over texts: cleaning, predicates, labels, transcripts, chunks, contexts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tessera.functions import chunkers as K
from tessera.functions import text as X
from tessera.operators import context as C
from tessera.operators import documents as D
from tessera.plans.registry import query
from tessera.plans.sql import with_views
from tessera.sources import files as S
from tessera.sources import graphs as G
from tessera.sources import views as V
from tessera.sources.tables import table

_WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c},'^{_WS}+',''),'{_WS}+\z','')"


def _norm(c: str) -> str:
    return rf"trim(regexp_replace({c},'{_WS}+',' ','g'))"


def _docs(spark, d, *cols):  # noqa: ANN001, ANN202
    return table(spark, d, "documents", "doc_id", *cols)


def _parsed(spark, d):  # noqa: ANN001, ANN202
    p = table(spark, d, "parsed_documents", "parsed_id", "source", "text").where("parsed_id is not null")
    return V.one_row(p, "parsed_id", "text", "source")


_P = "parsed_v as (select parsed_id, source, text from parsed_documents where parsed_id is not null qualify row_number() over (partition by parsed_id order by text desc nulls last, source desc nulls last)=1)"


@query("normalize_text", f"select doc_id, md5({_norm('text')}) as hash, length({_norm('text')}) as chars from documents where text is not null")
def normalize_text(spark, d):
    t = X.normalize_text(F.col("text"))
    return _docs(spark, d, "text").where("text is not null").select("doc_id", F.md5(t).alias("hash"), F.length(t).cast("long").alias("chars"))


@query("approx_tokens", "select doc_id, cast(ceil(coalesce(length(text),0)/4.0) as bigint) as tokens from documents")
def approx_tokens(spark, d):
    return _docs(spark, d, "text").select("doc_id", X.approx_tokens(F.col("text")).alias("tokens"))


@query("query_hash", "select doc_id, sha256(coalesce(text,'')) as hash from documents")
def query_hash(spark, d):
    return _docs(spark, d, "text").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))


@query("pdf_clean", rf"""WITH {_P} select parsed_id, md5({_strip(r"regexp_replace(regexp_replace(regexp_replace(text,'([a-z,])\n([a-z])','\1 \2','g'),'\n{3,}',chr(10)||chr(10),'g'),'-\n([a-z])','\1','g')")}) as hash from parsed_v where text is not null""")
def pdf_clean(spark, d):
    return _parsed(spark, d).where("text is not null").select("parsed_id", F.md5(X.clean_pdf_text(F.col("text"))).alias("hash"))


_NOISE = rf"""(regexp_matches({_strip('l')},'^\d{{1,4}}\z') or regexp_matches({_strip('l')},'(?i)^page\s+\d+(\s+of\s+\d+)?\z') or (regexp_matches({_strip('l')},'(?i)^chapter\s+\d+') and length({_strip('l')})<40) or (regexp_replace(l,'[^\f]','','g')=chr(12) and {_strip('l')}=''))"""


@query("pdf_pattern_noise", rf"""WITH {_P} select parsed_id, cast(len(list_filter(string_split(text,chr(10)), lambda l: {_NOISE})) as int) as dropped,
 md5({_strip(rf"regexp_replace(array_to_string(list_filter(string_split(text,chr(10)), lambda l: not {_NOISE}),chr(10)),'\n{{3,}}',chr(10)||chr(10),'g')")}) as hash from parsed_v where text is not null""")
def pdf_pattern_noise(spark, d):
    t = F.col("text")
    return _parsed(spark, d).where("text is not null").select("parsed_id", F.size(F.filter(F.split(t, "\n"), X.is_noise_line)).alias("dropped"), F.md5(X.strip_pattern_noise(t)).alias("hash"))


@query("pdf_repeated_lines", rf"""WITH {_P}, pages as (select parsed_id, regexp_split_to_array(text,'\f|\n{{4,}}') as p from parsed_v where text is not null),
 lines as (select distinct parsed_id, n, page, line from (select parsed_id, n, page, {_norm('raw')} as line from (select parsed_id, n, page, unnest(string_split(p[page],chr(10))) as raw from (select parsed_id, p, len(p) as n, unnest(range(1,len(p)+1)) as page from pages where len(p)>1))) where line<>'' and length(line)<=120)
 select parsed_id, line, count(*) as pages from lines group by parsed_id, line having count(*)>=greatest(3,floor(0.3*any_value(n)))""")
def pdf_repeated_lines(spark, d):
    return D.repeated_lines(_parsed(spark, d).where("text is not null"), "parsed_id", "text")


@query("pdf_noise_stripped")
def pdf_noise_stripped(spark, d):
    return D.strip_pdf_noise(_parsed(spark, d).where("text is not null"), "parsed_id", "text")


_HEAD = rf"({_strip('l')}<>'' and length({_strip('l')})<=80 and not regexp_matches({_strip('l')},'[.!?,;]\z') and regexp_matches({_strip('l')},'^[A-Z]') and len(string_split({_strip('l')},' '))<=10)"


@query("header_lines", rf"WITH {_P} select parsed_id, cast(len(list_filter(string_split(text,chr(10)), lambda l: {_HEAD})) as int) as headers from parsed_v where text is not null")
def header_lines(spark, d):
    return _parsed(spark, d).where("text is not null").select("parsed_id", F.size(F.filter(F.split("text", "\n"), X.is_header)).alias("headers"))


_LINES = rf"list_filter(list_transform(string_split(text,chr(10)), lambda l: {_strip('l')}), lambda l: l<>'')"


_QUOTED = "replace(text,chr(10),chr(10)||'^ ')"


@query("citation_filter", rf"""select doc_id, n, hits from (select doc_id, cast(len(x) as int) as n, cast(len(list_filter(x, lambda l: starts_with(l,'^ ') or regexp_matches(l,'^[A-Z][a-z]+.{{0,60}}\(\d{{4}}\)'))) as int) as hits from (select doc_id, {_LINES.replace("string_split(text", "string_split(" + _QUOTED)} as x from documents where text is not null)) where n>=2 and hits*1.0/n>0.5""")
def citation_filter(spark, d):
    """All texts with the mark of a reference before each line but the first, since no text is a bibliography as it stands."""
    text = F.replace("text", F.lit("\n"), F.lit("\n^ "))
    lines = X._lines(text)
    hits = F.filter(lines, lambda x: x.startswith("^ ") | x.rlike(r"^[A-Z][a-z]+.{0,60}\(\d{4}\)"))
    return _docs(spark, d, "text").where(X.is_citation_chunk(text)).select("doc_id", F.size(lines).alias("n"), F.size(hits).alias("hits"))


@query("glossary_filter", rf"""select doc_id from (select doc_id, len(x) as n, len(list_filter(x, lambda l: (regexp_matches(l,'^[A-Z][a-z]+.*[A-Z][a-z]') and length(l)<120) or (regexp_matches(l,'^[A-Z][A-Za-z\s\-]{{0,40}}:\s') and length(l)<150) or (regexp_matches(l,'^[A-Z][A-Za-z\s]{{0,40}}\s[—–]\s') and length(l)<150))) as hits from (select doc_id, {_LINES} as x from documents where text is not null)) where n>=4 and hits*1.0/n>0.45""")
def glossary_filter(spark, d):
    return _docs(spark, d, "text").where(X.is_glossary_chunk(F.col("text"))).select("doc_id")


@query("safe_filename", "select distinct source, lower(substr(regexp_replace(source,'[^a-zA-Z0-9]+','_','g'),1,40)) as name from chunks where source is not null")
def safe_filename(spark, d):
    return table(spark, d, "chunks", "source").where("source is not null").distinct().select("source", D.safe_filename(F.col("source")).alias("name"))


_SP = r"[ \t\n\x{0B}\f\r]+"


@query("script_spoken", rf"""select doc_id, cast(len(p) as int) as segments, cast(floor(words/150.0*60+0.5) as bigint) as seconds, md5(array_to_string(p,'|')) as hash from (select doc_id, p, list_sum(list_transform(p, lambda x: len(list_filter(regexp_split_to_array(x,'{_SP}'), lambda w: w<>'')))) as words from
 (select doc_id, list_filter(list_transform(range(0,len(f)), lambda i: trim(array_to_string(list_transform(f[i*2+1:i*2+2], lambda x: trim(x)),' '))), lambda x: x<>'') as p from (select doc_id, regexp_extract_all(text,'[^.!?]+[.!?]+') as f from documents where text is not null))) where len(p)>0""")
def script_spoken(spark, d):
    """Every text as a monologue: its segments and how long they take to speak."""
    s = _docs(spark, d, "text").where("text is not null").select("doc_id", D.script_segments(F.col("text"), "monologue").alias("s")).where("size(s) > 0")
    return s.select("doc_id", F.size("s").alias("segments"), D.script_seconds(F.col("s")).alias("seconds"), F.md5(F.array_join(F.transform("s", lambda x: x["text"]), "|")).alias("hash"))


@query("source_label", "select distinct source, case when regexp_matches(source,'(?i)^https?://') then source else string_split(source,'/')[-1] end as label from chunks where source is not null")
def source_label(spark, d):
    return table(spark, d, "chunks", "source").where("source is not null").distinct().select("source", X.source_label(F.col("source")).alias("label"))


@query("concept_label", with_views("concepts_v", rf"""select concept_id, case when length(t)<=60 then t when position(' ' in c)>0 and 60-position(' ' in reverse(c))>=30 then substr(c,1,60-position(' ' in reverse(c))) else c end as label
 from (select concept_id, t, substr(t,1,60) as c from (select concept_id, {_norm('summary')} as t from concepts_v where summary is not null))"""))
def concept_label(spark, d):
    return V.concepts(spark, d).where("summary is not null").select("concept_id", X.concept_label(F.col("summary")).alias("label"))


@query("parse_relationship", f"select rel, count(*) as n from (select case when lower({_strip('relationship')}) in ('supports','contradicts','example_of','caused_by','related_to') then lower({_strip('relationship')}) else 'related_to' end as rel from connections) group by 1")
def parse_relationship(spark, d):
    return table(spark, d, "connections", "relationship").groupBy(X.parse_relationship(F.col("relationship")).alias("rel")).agg(F.count("*").alias("n"))


@query("tags_parse", f"""select tags, list_filter(list_transform(case when tags is null then [] when starts_with(trim(tags),'[') then from_json(tags,'["VARCHAR"]') else string_split(tags,',') end, lambda l: {_strip('l')}), lambda l: l<>'') as parsed from (select distinct tags from chunks)""")
def tags_parse(spark, d):
    return table(spark, d, "chunks", "tags").distinct().select("tags", X.parse_tags(F.col("tags")).alias("parsed"))


@query("kind_router", f"""WITH {_P} select kind, count(*) as n from (select case when e in ('.mp3','.wav','.m4a','.ogg','.flac','.webm') then 'audio' when e in ('.png','.jpg','.jpeg','.gif','.bmp','.webp','.tiff') then 'image' when e in ('.mp4','.mov','.avi','.mkv') then 'video'
 when e in ('.txt','.md') then 'text' when e='.html' then 'html' when e='.pdf' then 'pdf' when e='.docx' then 'docx' end as kind from (select lower(regexp_extract(source,'(\\.[^./]+)$',1)) as e from parsed_v)) group by 1""")
def kind_router(spark, d):
    return _parsed(spark, d).groupBy(S.kind_of(F.col("source")).alias("kind")).agg(F.count("*").alias("n"))


@query("directory_filter", f"""WITH {_P} select parsed_id from parsed_v where lower(regexp_extract(source,'(\\.[^./]+)$',1)) in ('.txt','.md','.pdf','.docx','.html') and not regexp_matches(source,'(^|/)(\\.[^/]+|node_modules)(/|$)') and not regexp_matches(source,'(?i)^https?://')""")
def directory_filter(spark, d):
    return _parsed(spark, d).where(S.is_supported(F.col("source")) & ~S.is_url(F.col("source"))).select("parsed_id")


@query("new_files", with_views("chunks_v", f""", {_P} select parsed_id from parsed_v where string_split(source,'/')[-1] not in (select string_split(source,'/')[-1] from chunks_v where source is not null)"""))
def new_files(spark, d):
    return S.new_files(_parsed(spark, d).withColumnRenamed("source", "path").where("path is not null"), V.chunks(spark, d)).select("parsed_id")


_T = rf"""{_P}, raw as (select parsed_id, i-1 as n, trim(s[i]) as x from (select parsed_id, s, unnest(range(1,len(s)+1)) as i from (select parsed_id, string_split(text,chr(10)) as s from parsed_v where text is not null))),
 lines as (select parsed_id, cast(n as int) as n, cast(regexp_extract(x,'^\[(\d+):(\d{{2}})\]\s*(.+)$',1) as bigint)*60+cast(regexp_extract(x,'^\[(\d+):(\d{{2}})\]\s*(.+)$',2) as bigint) as start, regexp_extract(x,'^\[(\d+):(\d{{2}})\]\s*(.+)$',3) as line from raw where regexp_matches(x,'^\[(\d+):(\d{{2}})\]\s*(.+)$'))"""


@query("transcript_lines", f"WITH {_T} select * from lines")
def transcript_lines(spark, d):
    return D.transcript_lines(_parsed(spark, d).where("text is not null"), "parsed_id", "text")


@query("transcript_format", f"""WITH {_T} select parsed_id, md5(array_to_string(list('['||cast(cast(floor(start/60) as bigint) as varchar)||':'||lpad(cast(start%60 as varchar),2,'0')||'] '||trim(line) order by start, '['||cast(cast(floor(start/60) as bigint) as varchar)||':'||lpad(cast(start%60 as varchar),2,'0')||'] '||trim(line)),chr(10))) as hash from lines group by 1""")
def transcript_format(spark, d):
    seg = transcript_lines(spark, d).withColumnRenamed("line", "text")
    return D.transcript_text(seg, "parsed_id").select("parsed_id", F.md5("text").alias("hash"))


@query("frame_asof_merge", f"""WITH {_T}, frames as (select parsed_id, cast(unnest(range(0, cast(max(start)+90 as bigint), 45)) as double) as frame from lines group by 1)
 select f.parsed_id, f.frame, cast(min(l.start) as double) as line_start from frames f join lines l on l.parsed_id=f.parsed_id and l.start>=f.frame group by 1,2""")
def frame_asof_merge(spark, d):
    """Frames every 45 seconds put into the transcripts."""
    lines = transcript_lines(spark, d)
    frames = lines.groupBy("parsed_id").agg(F.max("start").alias("m")).select("parsed_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") + 89, F.lit(45).cast("long"))).alias("frame"))
    return D.frames_into_lines(lines, frames, "parsed_id")


@query("audio_window_chunks")
def audio_window_chunks(spark, d):
    """Windows of two minutes over all transcripts; checked against a fold in the tests."""
    p = _parsed(spark, d).where(S.kind_of(F.col("source")) == "audio").withColumn("kind", F.lit("audio"))
    return K.chunk_table(p, "parsed_id", "text", kind="kind")


@query("semantic_chunks")
def semantic_chunks(spark, d):
    return K.chunk_table(_parsed(spark, d), "parsed_id", "text", "fast")


@query("token_chunks")
def token_chunks(spark, d):
    return K.chunk_table(_parsed(spark, d), "parsed_id", "text", "token")


@query("segmented_chunks")
def segmented_chunks(spark, d):
    return K.chunk_table(_parsed(spark, d), "parsed_id", "text", "llm")


@query("llm_window_dedupe", with_views("chunks_v", """select source, page, text from (select source, min(page) over (partition by source, h) as page, t as text, row_number() over (partition by source, h order by length(t) desc, page, t) as n from
 (select source, page, trim(text) as t, lower(substr(trim(text),1,50)) as h from chunks_v where trim(text)<>'')) where n=1"""))
def llm_window_dedupe(spark, d):
    return D.longest_by_prefix(V.chunks(spark, d), "source", "page", "text")


@query("html_extract", rf"""WITH {_P} select parsed_id, md5(array_to_string(list_filter(list_transform(string_split(text,chr(10)), lambda l: trim(regexp_replace(l,'[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+',' ','g'))), lambda l: l<>''),chr(10)||chr(10))) as hash from parsed_v where regexp_matches(source,'^https?://') and text is not null""")
def html_extract(spark, d):
    """Web pages set as HTML with menus and advertisements, and read again."""
    from tessera.functions.html import html_text

    esc = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.array_join(F.transform(F.split(esc, "\n"), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "")
    page = F.concat(F.lit("<html><head><title>t</title><script>x()</script></head><body><nav><li>menu</li></nav><div>"), body, F.lit("</div><footer><p>end</p></footer></body></html>"))

    @F.pandas_udf("string")
    def read(s: pd.Series) -> pd.Series:
        return s.map(html_text)

    return _parsed(spark, d).where("source rlike '^https?://' and text is not null").select("parsed_id", F.md5(read(page)).alias("hash"))


_CLEAN = rf"list_filter(list_transform(string_split(text,chr(10)), lambda l: trim(regexp_replace(l,'[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+',' ','g'))), lambda l: l<>'')"


@query("page_extract", rf"""WITH {_P} select parsed_id, md5('# '||source||chr(10)||chr(10)||'about it'||case when len(x)>0 then chr(10)||chr(10)||array_to_string(x,chr(10)||chr(10)) else '' end) as hash, length(array_to_string(x,' ')) as bare from (select parsed_id, source, {_CLEAN} as x from parsed_v where regexp_matches(source,'^https?://') and text is not null)""")
def page_extract(spark, d):
    """Web pages set as fetched pages (title, description, notices in other letters' case), and as pages without any block."""
    from tessera.functions.html import html_text, page_text

    esc = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.array_join(F.transform(F.split(esc, "\n"), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "")
    head = F.concat(F.lit("<html><head><title>"), F.replace("source", F.lit("&"), F.lit("&amp;")), F.lit('</title><meta name="Description" content=" about  it"></head><body><div class="Site-Cookie"><p>accept</p></div><ASIDE><p>aside</p></ASIDE><div id="Top AD"><p>buy</p></div><main>'))
    page = F.concat(head, body, F.lit("</main></body></html>"))
    bare = F.concat(F.lit("<body><nav>menu</nav><div>"), esc, F.lit("</div></body>"))

    @F.pandas_udf("string")
    def read(s: pd.Series) -> pd.Series:
        return s.map(page_text)

    @F.pandas_udf("string")
    def stored(s: pd.Series) -> pd.Series:
        return s.map(html_text)

    return _parsed(spark, d).where("source rlike '^https?://' and text is not null").select("parsed_id", F.md5(read(page)).alias("hash"), F.length(stored(bare)).cast("long").alias("bare"))


@query("text_overlap", with_views("chunks_v", """select a, b, case when length(x)=0 or length(y)=0 then 0.0 else len(list_filter(range(0,cast(floor(length(s)/60) as bigint)), lambda i: contains(l, substr(s, i*60+1, 60))))*60.0/length(s) end as overlap from
 (select a.chunk_id as a, b.chunk_id as b, a.text as x, b.text as y, case when length(a.text)<=length(b.text) then a.text else b.text end as s, case when length(a.text)<=length(b.text) then b.text else a.text end as l from chunks_v a join chunks_v b on a.source=b.source and b.page=a.page+1 where a.text is not null and b.text is not null)"""), doubles="overlap")
def text_overlap(spark, d):
    """Each chunk with the next of its source."""
    c = V.chunks(spark, d).where("text is not null").select("chunk_id", "source", "page", "text")
    b = c.select(F.col("chunk_id").alias("b"), F.col("source").alias("s2"), (F.col("page") - 1).alias("p2"), F.col("text").alias("y"))
    j = c.join(b, (F.col("source") == F.col("s2")) & (F.col("page") == F.col("p2")))
    return j.select(F.col("chunk_id").alias("a"), "b", X.text_overlap(F.col("text"), F.col("y")).alias("overlap"))


def _found(spark, d):  # noqa: ANN001, ANN202
    from tessera.plans.queries_retrieval import _seeds

    c = G.vector_chunks(spark, d).select(F.col("vec_id").alias("id"), "chunk_id", "source", "text")
    return _seeds(spark, d).join(c, "id").select("q", F.col("chunk_id").alias("id"), "source", "text", "score")


_FOUND = " found as (select s.q, c.chunk_id as id, c.source, c.text, s.score from seeds_v s join vchunks_v c on c.vec_id=s.id)"


@query("context_budget", with_views("seeds_v vchunks_v", "," + _FOUND + rf""" select q, id, cast(used as bigint) as used, cast(place as int) as place from (select q, id, sum(tokens) over w as used, row_number() over w as place from (select q, id, score, ceil(length('----'||chr(10)||'Source: '||coalesce(source,'null')||chr(10)||chr(10)||coalesce({_strip('text')},'')||chr(10)||chr(10)||'----')/4.0) as tokens from found)
 window w as (partition by q order by score desc, id rows unbounded preceding)) where used<=500"""))
def context_budget(spark, d):
    return C.budgeted(_found(spark, d)).select("q", "id", "used", "place")


@query("context_build")
def context_build(spark, d):
    """Contexts of all query vectors, near-repeats left out, with the concepts found."""
    from tessera.plans.queries_retrieval import _hits

    hits = _hits(spark, d)
    concepts = hits.select("q", F.concat(F.lit("Label "), F.col("concept_id").cast("string")).alias("label"), F.lit("A concept of these vectors.").alias("summary"), "rank")
    return C.contexts(_found(spark, d), concepts)


@query("evidence_top", with_views("seeds_v vchunks_v", "," + _FOUND + " select q, id, cast(rank as int) as rank from (select q, id, row_number() over (partition by q order by score desc, id) as rank from found) where rank<=5"))
def evidence_top(spark, d):
    return C.evidence(_found(spark, d)).select("q", "id", "rank")
