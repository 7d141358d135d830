"""SQL of the queries that DuckDB can express over whole tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(lower(text),'[\p{L}\p{N}]+')"
_NORM = "nullif(lower(trim({0},' '||chr(9))),'')"
_B = r"[ \t\r\n\f]"
_LONGEST = "list_max(list_transform({0}, lambda x: length(regexp_replace(x,'^" + _B + "+|" + _B + "+$','','g'))))"

P1 = f"""WITH RECURSIVE words as (select distinct chunk_id, {_WORDS} as w from chunks where chunk_id is not null and text is not null),
 s as (select distinct chunk_id, w[i]||' '||w[i+1]||' '||w[i+2] as g from (select chunk_id, w, unnest(range(1,len(w)-1)) as i from words where len(w)>=20)),
 n as (select chunk_id, count(*) as n from s group by 1),
 links as (select a, b from (select x.chunk_id as a, y.chunk_id as b, count(*) as k from s x join s y on x.g=y.g and x.chunk_id<y.chunk_id group by 1,2) p join n na on na.chunk_id=a join n nb on nb.chunk_id=b where k*10>=6*(na.n+nb.n-k)),
 links2 as (select a, b from links union select b, a from links),
 reach(a,b) as (select a, a from links2 union select r.a, e.b from reach r join links2 e on e.a=r.b)
 select a as chunk_a, b as chunk_b from reach where a<b"""

P3 = f"""WITH RECURSIVE ids as (select distinct chunk_id, {_NORM.format("chunk_id")} as k from chunks where {_NORM.format("chunk_id")} is not null),
 sets as (select chr(2)||cast(row_number() over () as varchar) as a, json_extract(member_chunks,'$[*]') as m from concepts where json_valid(member_chunks) and json_type(member_chunks)='ARRAY'),
 links as (select {_NORM.format("source_chunk")} as a, {_NORM.format("target_chunk")} as b from connections where weight>=0.6 and cast(weight as varchar)<>'nan' and {_NORM.format("source_chunk")} in (select k from ids) and {_NORM.format("target_chunk")} in (select k from ids)
  union select a, b from (select a, lower(trim(x->>'$',' '||chr(9))) as b from (select a, unnest(m) as x from sets) where json_type(x)='VARCHAR') where b in (select k from ids)),
 links2 as (select a, b from links union select b, a from links),
 reach(a,b) as (select a, a from links2 union select r.a, e.b from reach r join links2 e on e.a=r.b)
 select i.chunk_id, g.group_id from ids i join (select r.a, min(j.chunk_id) as group_id, count(*) as n from reach r join ids j on j.k=r.b group by 1) g on g.a=i.k where n>1"""

P5 = rf"""WITH t as (select distinct parsed_id, regexp_replace(text,'^{_B}+|{_B}+$','','g') as t from parsed_documents where text is not null),
 s as (select parsed_id, t, regexp_split_to_array(t,'\n{_B}*\n') as p, string_split(regexp_replace(regexp_replace(regexp_replace(t,'\n{_B}*\n',chr(1),'g'),'([.!?]){_B}+','\1'||chr(1),'g'),'([。！？])','\1'||chr(1),'g'),chr(1)) as q, regexp_split_to_array(t,'{_B}+') as w from t where length(t)>1600)
 select distinct parsed_id, case when {_LONGEST.format("p")}<=1600 then 'paragraph' when {_LONGEST.format("q")}<=1600 then 'sentence' when {_LONGEST.format("w")}<=1600 then 'word' else 'none' end as boundary from s"""

P5_COVER = rf"""SELECT parsed_id, length(t) as chars, md5(t) as digest, 0 as empty, 0 as over from (select distinct parsed_id, regexp_replace(text,'{_B}+','','g') as t from parsed_documents where text is not null) where t<>''"""

P7 = f"""WITH d as (select doc_id, {_WORDS} as w from documents where text is not null), i as (select item_id, {_WORDS} as w from eval_items where text is not null),
 dg as (select distinct doc_id, array_to_string(w[k:k+11],' ') as g from (select doc_id, w, unnest(range(1,len(w)-10)) as k from d where len(w)>=12)),
 ig as (select distinct item_id, array_to_string(w[k:k+11],' ') as g from (select item_id, w, unnest(range(1,len(w)-10)) as k from i where len(w)>=12))
 select distinct doc_id, item_id from dg join ig using (g)"""

SQL = {"p1_found": P1, "p3_found": P3, "p5_found": P5, "p5_cover": P5_COVER, "p7_found": P7}
