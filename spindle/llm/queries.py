"""The ten operators as queries over the whole tables, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import extraction, fingerprints, language, minhash, mixing, packing, quality, secrets, substrings, topk


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(_read(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(_read(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(_read(spark, sf_dir, "pages"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_read(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_read(spark, sf_dir, "documents"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_substring_dedup, op2_minhash_near_dedup, op3_secret_scan, op4_best_fit_packing, op5_html_extraction, op6_quality_classifier, op7_source_mixing, op8_language_id, op9_fingerprints, op10_exact_top_k)
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": """
        with d as (select row_number() over () n, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\v\\f\\r]+'), lambda w: w <> '') w from documents),
        p as (select n, doc_id, w, unnest(range(1, len(w) - 48)) i from d where len(w) >= 50),
        h as (select n, doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) h from p),
        m as (select h, min(doc_id) first from h group by h),
        c as (select distinct n, unnest(range(i, i + 50)) i from h join m using (h) where first < doc_id),
        r as (select n, list(i) gone from c group by n),
        k as (select doc_id, w, coalesce(gone, []) gone, list_filter(w, lambda x, i: not list_contains(coalesce(gone, []), i)) kept from d left join r using (n))
        select doc_id, cast(len(w) as bigint) n_words, cast(len(gone) as bigint) n_removed, sha256(array_to_string(kept, ' ')) kept_sha256 from k""",
    "op2_minhash_near_dedup": """
        with recursive d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\v\\f\\r]+'), lambda w: w <> '') w from documents),
        n as (select doc_id, w, case when len(w) = 0 then ' ' || doc_id else md5(array_to_string(w, ' ')) end t from d where doc_id is not null),
        s as (select t, any_value(w) w from n where len(w) > 0 group by t),
        g as (select t, unnest(case when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end) g from s),
        c as (select t, g, cast(count(*) as double) c from g group by t, g),
        f as (select t, g, c, c / sum(c) over (partition by t) as share from c),
        p as (select a.t a, b.t b from f a join f b on a.g = b.g and a.t < b.t group by a.t, b.t having sum(least(a.share, b.share)) >= cast(0.8 as double) - 1e-9),
        u as (select a, b, g, sum(x) x, sum(y) y from (select a, b, g, c x, 0 y from p join c on t = a union all select a, b, g, 0 x, c y from p join c on t = b) group by a, b, g),
        r as (select a, b, x, y, case when x = 0 then cast('infinity' as double) else y / x end ratio from u),
        q as (select a, b, x, y, sum(x) over upto below, sum(y) over (partition by a, b) - sum(y) over upto above from r window upto as (partition by a, b order by ratio)),
        j as (select a, b from q where x > 0 and y > 0 group by a, b having sum(1 / (below / x + above / y)) >= cast(0.8 as double) - 1e-9),
        e as (select a, b from j union select b, a from j union select k.t, l.t from n k join n l on k.doc_id = l.doc_id and k.t <> l.t),
        o as (select t a, t b from n union select o.a, e.b from o join e on o.b = e.a),
        m as (select t, min(doc_id) least_id from n group by t),
        v as (select a t, min(least_id) class_id from o join m on o.b = m.t group by a)
        select doc_id, class_id from n join v using (t) union all select doc_id, null from d where doc_id is null""",
    "op3_secret_scan": """
        with x as (select row_number() over () id, doc_id, coalesce(text, '') t from documents),
        o as (select id, 0 k, t, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)' p, 2 grp from x union all select id, 1, t, 'AKIA[A-Z0-9]{12,}', 0 from x
              union all select id, 2, t, '[0-9a-f]{32,}', 0 from x union all select id, 3, t, '[A-Za-z0-9+/_-]{24,}', 0 from x),
        r as (select id, k, string_split_regex(t, p) gaps, regexp_extract_all(t, p, 0) m, case grp when 2 then regexp_extract_all(t, p, 2) else regexp_extract_all(t, p, 0) end v from o),
        y as (select id, k, unnest(gaps[1 : len(m)]) gap, unnest(m) m, unnest(v) v, unnest(range(len(m))) i from r where len(m) > 0),
        f as (select id, k, m, v, sum(length(gap) + length(m)) over (partition by id, k order by i) till from y),
        b as (select id, k, till - length(m) start, till from f where k < 3 and (k > 0 or length(v) >= 8)),
        n as (select row_number() over () tok, id, till - length(m) start, till, m t, case
                  when regexp_matches(m, '^[0-9a-fA-F_-]+$') and regexp_matches(m, '[0-9]') and regexp_matches(m, '[a-fA-F]') then 1
                  when regexp_matches(m, '^[A-Z2-7_-]+$') and regexp_matches(m, '[2-7]') and regexp_matches(m, '[A-Z]') then 2
                  when regexp_matches(m, '^([0-9a-z_-]+|[0-9A-Z_-]+)$') and regexp_matches(m, '[0-9]') and regexp_matches(m, '[a-zA-Z]') then 3
                  when regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Z]') and regexp_matches(m, '[a-z]') then 4 end e from f where k = 3),
        al as (select unnest([1, 2, 3, 4]) e, unnest(['0123456789abcdef', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', '0123456789abcdefghijklmnopqrstuvwxyz',
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/']) symbols),
        lt(c, p) as (values LETTERS),
        la as (select e, lt.c, cast(p as double) p, ln(sum(cast(p as double)) over (partition by e) / (count(*) over (partition by e) * cast(p as double))) ratio from al join lt on contains(lower(symbols), lt.c) where e < 4),
        lm as (select e, sum(p * ratio) / sum(p) mu, sqrt(sum(p * ratio * ratio) / sum(p) - power(sum(p * ratio) / sum(p), 2)) dev from la group by e),
        sy as (select tok, e, symbols, case e when 4 then translate(t, '-_', '+/') when 2 then replace(replace(t, '-', ''), '_', '') else lower(replace(replace(t, '-', ''), '_', '')) end s from n join al using (e)),
        ch as (select tok, e, symbols, cast(length(s) as double) n, unnest(string_split(s, '')) c, unnest(range(length(s))) i from sy),
        ci as (select tok, e, n, c, i, cast(length(symbols) as double) size, cast(instr(symbols, c) as double) q,
                      case when c between 'A' and 'Z' then 'u' when c between 'a' and 'z' then 'l' when c between '0' and '9' then '0' else 'o' end g from ch),
        nx as (select *, lead(q) over w q2, g <> lead(g) over w as change from ci window w as (partition by tok order by i)),
        sq as (select tok, sum(many * many) squares from (select tok, c, cast(count(*) as double) many from ci group by tok, c) group by tok),
        st as (select tok, nx.e, n, size, sum(q) / n mean, sum(q * q) qq, sum(q * q2) qr, min(case when i = 0 then q end) q_first, min(case when i = n - 1 then q end) q_last,
                      sum(case when change then 1 else 0 end) changes, sum(case when la.c is null then 0 else 1 end) letters, sum(coalesce(ratio, 0)) ratios
               from nx left join la on nx.e = la.e and lower(nx.c) = la.c group by tok, nx.e, n, size),
        sv as (select st.*, squares * size / n - n chi, qq - n * mean * mean v, qr - mean * (2 * n * mean - q_first - q_last) + (n - 1) * mean * mean cov from st join sq using (tok)),
        ev as (select *, (power(greatest(chi, 0) / (size - 1), cast(1 as double) / 3) - (1 - 2 / (9 * (size - 1)))) / sqrt(2 / (9 * (size - 1))) even from sv),
        zs as (select tok, (case when ev.e = 4 then (size - 1 + n * (size * cast(0.065 as double) - 1) - chi) / (2 * size * sqrt(n * (cast(0.0055 as double) - cast(0.065 as double) * cast(0.065 as double))))
                                 else (ratios - letters * mu) / (sqrt(letters) * dev) end
                            + (changes - (n - 1) * cast(0.15 as double)) / sqrt((n - 1) * cast(0.1275 as double))) / sqrt(cast(2 as double)) z
               from ev left join lm on ev.e = lm.e where not (even < -4 or (ev.e <> 4 and even > 5) or abs(cov) * sqrt(n) > 4 * v or v <= 1e-9)),
        pv as (select id, start, till, case when z > 0 then exp(-z * z / 2) / 2 else cast(1 as double) end * avg(till - start) over (partition by id) / (till - start) p, count(*) over (partition by id) tested from zs join n using (tok)),
        rk as (select *, row_number() over (partition by id order by p, start) place from pv),
        lv as (select *, max(case when p <= place * cast(0.001 as double) / tested then p end) over (partition by id) as "level" from rk),
        ad as (select id, 3 k, start, till from lv where p <= "level" and not exists (select 1 from b where b.id = lv.id and b.start < lv.till and lv.start < b.till)),
        al2 as (select id, k, start, till, ['assign', 'access', 'hex', 'random'][k + 1] || ':' || cast(start as bigint) || ':' || cast(till as bigint) label from (select * from b union all select * from ad)),
        ag as (select id, count(*) filter (where k = 0) n_assign, count(*) filter (where k = 1) n_access, count(*) filter (where k = 2) n_hex, count(*) filter (where k = 3) n_random,
                      string_agg(label, ',' order by start, k) filter (where k < 3) base, string_agg(label, ',' order by start, k) spans from al2 group by id)
        select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans, coalesce(n_random, 0) n_random
        from x left join ag using (id)""".replace("LETTERS", ", ".join(f"('{c}', {p})" for c, p in secrets.TEXT_LETTERS.items())),
    "op7_source_mixing": """
        with d as (select doc_id, source, coalesce(text, '') t from documents),
        b as (select doc_id, source, t, cast(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) as bigint) size,
                     length(regexp_replace(t, '[^\\p{L}\\x20\\x09-\\x0D]+', '', 'g')) / cast(greatest(length(t), 1) as double) q,
                     (cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || t), 1, 13) as bigint) + 0.5) / cast(4503599627370496 as double) u from d),
        k as (select doc_id, source, size, cast(floor(-ln(u) / least(greatest(q * q * q * q, cast(0.01 as double)), cast(1 as double)) * cast(281474976710656 as double)) as bigint) key from b),
        s as (select source, cast(sum(size) as bigint) source_size from k group by source),
        w as (select *, cast((row_number() over (order by source is null, source) - 1) % 3 + 1 as double) w, cast(source_size * 3 as double) ceiling from s),
        l as (select *, (sum(source_size) over () - coalesce(sum(ceiling) over (order by ceiling / w, source is null, source rows between unbounded preceding and 1 preceding), 0))
                        / sum(w) over (order by ceiling / w, source is null, source rows between current row and unbounded following) as "level" from w),
        f as (select *, ceiling <= w * "level" as "full" from l),
        g as (select *, (cast(sum(source_size) over () as double) - coalesce(sum(case when "full" then ceiling end) over (), 0)) / sum(case when not "full" then w end) over () as rate from f),
        t as (select source, source_size, case when "full" then ceiling else w * rate end target from g),
        e as (select *, case when source_size = 0 then 0 else least(cast(floor(target / greatest(source_size, 1)) as bigint), 3) end epochs from t),
        c as (select k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size rest,
                     sum(k.size) over (partition by k.source order by k.key) upto, sum(k.size) over (partition by k.source, k.key) peers
              from k join e on k.source is not distinct from e.source)
        select doc_id, size, source_size, target, cast(size * (epochs + case when upto - peers / 2.0 <= rest then 1 else 0 end) as bigint) taken from c""",
    "op10_exact_top_k": """
        with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) e from embeddings
                   where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) score
              from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
        r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) rank from s)
        select query_id, rank, vec_id, score from r where rank <= 10""",
}
