"""The canonical views in DuckDB's SQL, for the SQL that checks the queries."""

from __future__ import annotations


def _moment(c: str) -> str:
    return f"strptime(substr(replace({c},'T',' '),1,19),'%Y-%m-%d %H:%M:%S')"


def _ids(c: str) -> str:
    return (
        f"case when json_valid({c}) and json_type({c})='ARRAY' then list_transform(list_filter(json_extract({c},'$[*]'), "
        f"lambda x: json_type(x)='VARCHAR' and (x->>'$')<>''), lambda x: lower(trim(x->>'$', ' '||chr(9)))) else [] end"
    )


_DB = "coalesce(nullif(database_id,''),'default')"
_NODE = "nullif(lower(trim({0},' '||chr(9))),'')"

VIEWS = {
    "chunks_v": f"""select * from (select chunk_id, text, source, page, {_moment("timestamp")} as ts, access_count, {_moment("last_accessed")} as last_accessed, tags, metadata, is_duplicate, contradiction_flag, {_DB} as database_id
        from chunks where chunk_id is not null) qualify row_number() over (partition by chunk_id order by access_count desc nulls last, last_accessed desc nulls last, ts desc nulls last, text desc nulls last, source desc nulls last, page desc nulls last, tags desc nulls last, metadata desc nulls last, is_duplicate desc nulls last, contradiction_flag desc nulls last, database_id desc nulls last)=1""",
    "edges_v": f"""select * from (select edge_id, {_NODE.format("source_chunk")} as source_chunk, {_NODE.format("target_chunk")} as target_chunk, relationship,
        weight, confidence, {_moment("created_at")} as created_at, {_moment("last_reinforced")} as last_reinforced, {_DB} as database_id, access_count,
        support_count, contradict_count, seen_count, {_moment("last_seen")} as last_seen, avg_sim, evidence_score, weight_version from connections)
        where source_chunk is not null and target_chunk is not null and weight is not null and cast(weight as varchar)<>'nan'
        qualify row_number() over (partition by source_chunk, target_chunk, relationship order by created_at nulls first, edge_id)=1""",
    "concepts_v": f"""select concept_id, label, summary, {_ids("member_chunks")} as raw_members, list_sort(list_distinct(list_filter({_ids("member_chunks")}, lambda x: x<>''))) as members,
        {_moment("created_at")} as created_at, {_moment("last_updated")} as last_updated, {_DB} as database_id, confidence,
        coalesce(version,1) as version, coalesce(embedding_version,0) as embedding_version from concepts where concept_id is not null
        qualify row_number() over (partition by concept_id order by {_moment("last_updated")} desc nulls last, label desc nulls last, summary desc nulls last)=1""",
    "ingest_v": f"""select * from (select event_id, source, chunks_stored, chunks_skipped, connections_seeded, tags, {_moment("timestamp")} as ts, {_DB} as database_id from ingest_events where event_id is not null)
        qualify row_number() over (partition by event_id order by ts desc nulls last, chunks_stored desc nulls last, chunks_skipped desc nulls last, connections_seeded desc nulls last, source desc nulls last, tags desc nulls last, database_id desc nulls last)=1""",
    "coaccess_v": f"""select event_id, query_hash, ts, database_id, list_filter(raw, lambda x, i: list_position(raw, x)=i) as ids from (select event_id, {_ids("chunk_ids")} as raw, query_hash, ts, database_id
        from (select event_id, chunk_ids, query_hash, query_embedding, "timestamp" as ts, {_DB} as database_id from co_access_events where event_id is not null)
        qualify row_number() over (partition by event_id order by ts desc nulls last, chunk_ids desc nulls last, query_hash desc nulls last, database_id desc nulls last, query_embedding desc nulls last)=1)""",
    "vectors_v": "select vec_id, cast(embedding as double[]) as v, label, 'db'||cast(label%2 as varchar) as database_id from embeddings",
}
_NEEDS = {"knn_v": ("vectors_v",), "vedges_v": ("edges_v", "vectors_v"), "vchunks_v": ("chunks_v", "vectors_v"), "seeds_v": ("vectors_v",), "walks_v": ("seeds_v", "vedges_v"), "vconcepts_v": ("vectors_v",)}

# every vector's nearest six, from queries whose id is divisible by 20
VIEWS["knn_v"] = """select q as vec_id, c as target_id, sim, rk from (select q.vec_id as q, c.vec_id as c, list_cosine_similarity(q.v,c.v) as sim,
    row_number() over (partition by q.vec_id order by list_cosine_similarity(q.v,c.v) desc, c.vec_id) as rk
    from vectors_v q join vectors_v c on q.vec_id<>c.vec_id where q.vec_id%20=0) where rk<=6"""


def _vec(c: str) -> str:
    return f"cast(cast('0x'||substr({c},1,6) as bigint) % (select count(*) from vectors_v) as bigint)"


# the graph of connections, carried over to the vectors
VIEWS["vedges_v"] = f"""select source, target, relationship, max(weight) as w from (select {_vec("source_chunk")} as source, {_vec("target_chunk")} as target, relationship, weight from edges_v
    where regexp_full_match(substr(source_chunk,1,6),'[0-9a-f]{{6}}') and regexp_full_match(substr(target_chunk,1,6),'[0-9a-f]{{6}}')) where source<>target and weight<=1 group by 1,2,3"""
VIEWS["vchunks_v"] = f"""select vec_id, chunk_id, source, text from (select {_vec("lower(chunk_id)")} as vec_id, chunk_id, source, text from chunks_v where regexp_full_match(lower(substr(chunk_id,1,6)),'[0-9a-f]{{6}}'))
    qualify row_number() over (partition by vec_id order by chunk_id)=1"""
# the ten nearest vectors of the same database, the query itself among them
VIEWS["seeds_v"] = """select q, id, score, rk from (select q.vec_id as q, c.vec_id as id, list_cosine_similarity(q.v,c.v) as score,
    row_number() over (partition by q.vec_id order by list_cosine_similarity(q.v,c.v) desc, c.vec_id) as rk
    from vectors_v q join vectors_v c on q.database_id=c.database_id where q.vec_id%20=0) where rk<=10"""
_BEST = "qualify row_number() over (partition by q,id order by score desc, depth, path)=1"


def walks(hops: int, where: str = "true", name: str = "walks_v") -> str:
    """SQL of the best walk to each node, level by level; adds CTEs l0 to lN."""
    out = ["l0 AS (select q, id, score, 0 as depth, [cast(id as varchar)] as path, score as vec from seeds_v)"]
    for d in range(1, hops + 1):
        out.append(f"l{d} AS (select * from (select f.q, e.target as id, f.score*pow(0.9,{d})*e.w as score, {d} as depth, list_append(f.path, cast(e.target as varchar)) as path, f.vec from l{d - 1} f join vedges_v e on e.source=f.id where e.w>0.3 and {where}) {_BEST})")
    union = " union all ".join(f"select * from l{d}" for d in range(hops + 1))
    return ",\n".join(out) + f",\n{name} AS (select * from ({union}) {_BEST})"


# concepts over the vectors: one for each label
VIEWS["vconcepts_v"] = """select label as concept_id, list(vec_id order by vec_id) as members, 0.3+0.05*label as confidence from vectors_v group by label"""


def with_views(names: str, body: str) -> str:
    """SQL with the named views before it."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, ()):
            add(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    # a body that begins with a comma adds views of its own
    return f"WITH {views}{'' if body.lstrip().startswith(',') else chr(10)}{body}"
