"""DuckDB SQL for the queries that SQL can express."""

ORACLE = {
    "op1_warc": """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, payload_bytes, max(page_id) as first_id from p where payload_bytes >= 1000 group by all)
select page_id, cast(p.payload_bytes as bigint) as payload_bytes, p.payload_digest, case when page_id < first_id then 'revisit' else 'response' end as record_type,
 case when page_id < first_id then first_id end as refers_to from p left join f using (payload_digest, payload_bytes)""",
    "op6_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64.0 * cast(x as double))) as v from embeddings
 where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score from v q, v c where q.vec_id % 20 = 0 and q.vec_id <> c.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
qualify rank <= 20""",
}
