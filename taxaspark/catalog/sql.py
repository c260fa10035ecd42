"""DuckDB statements that compute the registered queries from the given tables."""

from __future__ import annotations

import re

from taxaspark.sources.derived import BASES, LETTERS

RANK_LIST = "['species','genus','family','order']"


def geo(lat1, lon1, lat2, lon2) -> str:
    a = (
        f"power(sin((radians({lat2})-radians({lat1}))/2),2)+cos(radians({lat1}))*cos(radians({lat2}))"
        f"*power(sin((radians({lon2})-radians({lon1}))/2),2)"
    )
    return f"(2*6371.0::DOUBLE*asin(sqrt(greatest(0.0::DOUBLE,least(1.0::DOUBLE,{a})))))"


def vec_key(column: str) -> str:
    return f"array_to_string(list_transform({column}, lambda x: CAST(round(x*1e6) AS BIGINT)), ',')"


def splits_of(src: str, fractions: str = "[0.3,0.5,0.7]", val: str = "0.15", prefix: str = "") -> dict[str, str]:
    p = prefix
    return {
        f"{p}fr": f"SELECT unnest({fractions}::DOUBLE[]) AS holdout_fraction",
        f"{p}genera": f"SELECT holdout_fraction, genus, row_number() OVER (PARTITION BY holdout_fraction ORDER BY md5('42|'||genus), genus) rn, "
        f"count(*) OVER (PARTITION BY holdout_fraction) n FROM (SELECT DISTINCT genus FROM {src}) g, {p}fr",
        f"{p}held": f"SELECT holdout_fraction, genus FROM {p}genera WHERE rn <= round_even(n*holdout_fraction, 0)",
        f"{p}spread": f"SELECT r.*, holdout_fraction FROM {src} r, {p}fr",
        f"{p}seen": f"SELECT s.* FROM {p}spread s ANTI JOIN {p}held h USING (holdout_fraction, genus)",
        f"{p}ranked": f"SELECT *, row_number() OVER (PARTITION BY holdout_fraction, species ORDER BY md5('42|'||process_id), process_id) rn, "
        f"count(*) OVER (PARTITION BY holdout_fraction, species) n FROM {p}seen",
        f"{p}rows": f"SELECT * EXCLUDE (rn, n), CASE WHEN rn <= (CASE WHEN n >= 2 THEN floor(n*{val}::DOUBLE) ELSE 0 END) THEN 'val' ELSE 'train' END AS split FROM {p}ranked "
        f"UNION ALL BY NAME SELECT s.*, 'test' AS split FROM {p}spread s SEMI JOIN {p}held h USING (holdout_fraction, genus)",
    }


def fallback_of(rows: str, dims: int, prefix: str = "", percentile: str = "0.9", k: int = 5) -> dict[str, str]:
    """Centroids, scales, distances, thresholds and the cascade over a split table with ``vec``."""
    p = prefix
    above = lambda d: [r if i >= d else None for i, r in enumerate(("species", "genus", "family", "order"))]
    lineage = "CASE rank " + " ".join(
        f"WHEN '{r}' THEN {{'species':{_n(a[0])},'genus':{_n(a[1])},'family':{_n(a[2])},'order':{_n(a[3])}}}"
        for i, r in enumerate(("species", "genus", "family", "order"))
        for a in [above(i)]
    ) + " END"
    return {
        f"{p}long": f"""SELECT *, unnest({RANK_LIST}) AS rank, unnest([species, genus, family, "order"]) AS label FROM {rows}""",
        f"{p}ctrain": f"SELECT *, {lineage} AS lin FROM {p}long WHERE split = 'train'",
        f"{p}cmean": f"SELECT holdout_fraction, rank, label, pos, avg(vec[pos]) AS m FROM {p}ctrain, range(1, {dims + 1}) t(pos) GROUP BY ALL",
        f"{p}cvec": f"SELECT holdout_fraction, rank, label, list(m ORDER BY pos) AS vec FROM {p}cmean GROUP BY ALL",
        f"{p}cmeta": f"SELECT holdout_fraction, rank, label, count(*) AS support, avg(lat) FILTER (lat IS NOT NULL AND lon IS NOT NULL) AS lat, "
        f"avg(lon) FILTER (lat IS NOT NULL AND lon IS NOT NULL) AS lon, arg_min(lin, process_id) AS lin FROM {p}ctrain GROUP BY ALL",
        f"{p}cent": f"SELECT * FROM {p}cvec JOIN {p}cmeta USING (holdout_fraction, rank, label)",
        f"{p}seqscale": f"SELECT g.holdout_fraction, g.rank, greatest(coalesce(nullif(m, 0), 1.0), 1e-9)::DOUBLE AS seq_scale FROM "
        f"(SELECT DISTINCT holdout_fraction, rank FROM {p}cent) g LEFT JOIN "
        f"(SELECT a.holdout_fraction, a.rank, median(list_distance(a.vec, b.vec)) m FROM {p}cent a JOIN {p}cent b "
        f"ON a.holdout_fraction=b.holdout_fraction AND a.rank=b.rank AND a.label<b.label GROUP BY ALL) USING (holdout_fraction, rank)",
        f"{p}geoscale": f"SELECT a.holdout_fraction, a.rank, greatest(median({geo('a.lat', 'a.lon', 'b.lat', 'b.lon')}), 1e-9)::DOUBLE AS geo_scale FROM {p}cent a JOIN {p}cent b "
        f"ON a.holdout_fraction=b.holdout_fraction AND a.rank=b.rank AND a.label<b.label WHERE a.lat IS NOT NULL AND b.lat IS NOT NULL GROUP BY ALL",
        f"{p}dist": f"""SELECT q.holdout_fraction, q.split, q.process_id, c.rank, c.label, c.support, c.lin,
            CASE WHEN q.lat IS NOT NULL AND q.lon IS NOT NULL AND c.lat IS NOT NULL AND g.geo_scale IS NOT NULL
            THEN 0.8::DOUBLE*list_distance(q.vec, c.vec)/s.seq_scale + 0.2::DOUBLE*{geo('q.lat', 'q.lon', 'c.lat', 'c.lon')}/g.geo_scale
            ELSE list_distance(q.vec, c.vec)/s.seq_scale END AS d
            FROM {rows} q JOIN {p}cent c USING (holdout_fraction) JOIN {p}seqscale s ON s.holdout_fraction=c.holdout_fraction AND s.rank=c.rank
            LEFT JOIN {p}geoscale g ON g.holdout_fraction=c.holdout_fraction AND g.rank=c.rank WHERE q.split <> 'train'""",
        f"{p}place": f"SELECT *, row_number() OVER (PARTITION BY holdout_fraction, process_id, rank ORDER BY d, label) AS rn FROM {p}dist",
        f"{p}near": f"SELECT * FROM {p}place WHERE rn = 1",
        f"{p}cut": f"SELECT g.holdout_fraction, g.rank, coalesce(t, 0.0) AS t FROM (SELECT DISTINCT holdout_fraction, rank FROM {p}cent) g LEFT JOIN "
        f"(SELECT holdout_fraction, rank, quantile_cont(d, {percentile}) t FROM {p}near WHERE split = 'val' GROUP BY ALL) USING (holdout_fraction, rank)",
        f"{p}conf": f"""SELECT n.*, t, CASE WHEN t <= 1e-12 THEN (CASE WHEN d <= 1e-12 THEN 1.0 ELSE 0.0 END)
            ELSE least(1.0, greatest(0.0, 1.0 - d/t)) END * (support::DOUBLE/(support+5.0::DOUBLE)) AS confidence
            FROM {p}near n JOIN {p}cut USING (holdout_fraction, rank)""",
        f"{p}commit": f"""SELECT holdout_fraction, split, process_id,
            arg_min(rank, list_position({RANK_LIST}, rank)) FILTER (d <= t) AS predicted_rank,
            arg_min(lin, list_position({RANK_LIST}, rank)) FILTER (d <= t) AS lin,
            max(label) FILTER (rank = 'species') AS closest
            FROM {p}conf GROUP BY ALL""",
        f"{p}pred": f"""SELECT c.holdout_fraction, c.split, c.process_id, c.predicted_rank, c.predicted_rank IS DISTINCT FROM 'species' AS is_novel, c.closest,
            c.lin.species AS species, c.lin.genus AS genus, c.lin.family AS family, c.lin."order" AS "order",
            q.species AS true_species, q.genus AS true_genus, q.family AS true_family, q."order" AS true_order
            FROM {p}commit c JOIN {rows} q USING (holdout_fraction, process_id)""",
        f"{p}ours": f"""SELECT 'ours' AS method, p.holdout_fraction, p.split, p.process_id, p.predicted_rank, p.is_novel, f.rank,
            CASE f.rank WHEN 'species' THEN true_species WHEN 'genus' THEN true_genus WHEN 'family' THEN true_family ELSE true_order END AS truth,
            CASE f.rank WHEN 'species' THEN species WHEN 'genus' THEN genus WHEN 'family' THEN family ELSE "order" END AS call,
            f.label AS nearest, f.confidence FROM {p}pred p JOIN {p}conf f USING (holdout_fraction, process_id)""",
    }


def neighbours_of(rows: str, prefix: str) -> dict[str, str]:
    """Nearest training row, leave-one-out scale and calls over a split table with ``vec``."""
    p = prefix
    return {
        f"{p}pairs": f"SELECT q.holdout_fraction, q.process_id, t.process_id AS nearest_id, list_distance(q.vec, t.vec) AS d FROM {rows} q JOIN {rows} t USING (holdout_fraction) WHERE q.split<>'train' AND t.split='train'",
        f"{p}nn": f"SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY holdout_fraction, process_id ORDER BY d, nearest_id) rn FROM {p}pairs) WHERE rn=1",
        f"{p}loo": f"SELECT a.holdout_fraction, a.process_id, min(list_distance(a.vec, b.vec)) AS d FROM {rows} a JOIN {rows} b ON a.holdout_fraction=b.holdout_fraction AND a.process_id<>b.process_id WHERE a.split='train' AND b.split='train' GROUP BY ALL",
        f"{p}nnscale": f"SELECT holdout_fraction, CASE WHEN median(d)<=1e-12 THEN 1.0 ELSE median(d) END AS scale FROM {p}loo GROUP BY ALL",
        f"{p}nncall": f"""SELECT q.holdout_fraction, q.split, q.process_id, nearest_id, d, least(1.0, greatest(0.0, exp(-d/scale))) AS confidence, t.species, t.genus, t.family, t."order",
            q.species AS true_species, q.genus AS true_genus, q.family AS true_family, q."order" AS true_order
            FROM {p}nn n JOIN {rows} q USING (holdout_fraction, process_id) JOIN {rows} t ON t.holdout_fraction=n.holdout_fraction AND t.process_id=n.nearest_id JOIN {p}nnscale s ON s.holdout_fraction=n.holdout_fraction""",
        f"{p}nnlong": f"""SELECT 'nearest_neighbor' AS method, holdout_fraction, split, process_id, NULL::VARCHAR AS predicted_rank, NULL::BOOLEAN AS is_novel,
            unnest({RANK_LIST}) AS rank, unnest([true_species, true_genus, true_family, true_order]) AS truth, unnest([species, genus, family, "order"]) AS call,
            unnest([species, genus, family, "order"]) AS nearest, confidence FROM {p}nncall""",
    }


def _n(x):
    return "NULL::VARCHAR" if x is None else ('"order"' if x == "order" else x)


PIECES = f"""SELECT doc_id, piece, 'D'||doc_id||'_'||piece AS process_id, lang||'_s'||srcn AS species, lang||'_g'||(srcn%5) AS genus,
    lang||'_f'||(srcn%5%2) AS family, lang AS "order", substr(dna, piece*len+1, len) AS sequence,
    CASE WHEN doc_id%10<>0 THEN ((doc_id*37)%180-90)::DOUBLE END AS lat, CASE WHEN doc_id%10<>0 THEN ((doc_id*53)%360-180)::DOUBLE END AS lon
    FROM (SELECT *, unnest(range(0, (length(dna)-1)//len+1)) AS piece FROM docs)"""

AMBIGUOUS = "(CASE WHEN length({0})=0 THEN 1.0 ELSE (length({0})-length(regexp_replace({0},'[^ACGTacgt]','','g')))::DOUBLE/length({0}) END)"

BASE: dict[str, str] = {
    "docs": f"""SELECT * FROM (SELECT doc_id, lang, CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) AS srcn,
        translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}') AS dna, (500+doc_id%300)::INT AS len FROM documents) WHERE length(dna) > 0""",
    "pieces": PIECES,
    "barcodes": """SELECT species, genus, family, "order", sequence, lat, lon, process_id, 'BIN:'||species AS bin_uri FROM pieces""",
    "clean": f"""SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY species, sequence ORDER BY process_id) AS rn FROM barcodes
        WHERE length(sequence) BETWEEN 500 AND 750 AND {AMBIGUOUS.format('sequence')} <= 0.01) WHERE rn = 1""",
    "twice": "SELECT *, unnest([0,1]) AS copy, doc_id+piece AS n FROM pieces",
    "sub": """SELECT *, CASE WHEN copy=1 THEN chr(9)||' '||lower(sequence)||' '||chr(10) ELSE sequence END AS seq, (CASE WHEN copy=1 THEN 'E' ELSE '' END)||process_id AS pid,
        CASE WHEN n%7=0 THEN '16S' ELSE 'COI-5P' END AS mark FROM twice""",
    "raw": """SELECT CASE WHEN n%3<>0 THEN species ELSE '' END AS species, CASE WHEN n%3=0 THEN species END AS species_name,
        CASE WHEN n%11<>0 THEN genus ELSE '' END AS genus, CASE WHEN n%13<>0 THEN family END AS family, "order",
        CASE WHEN n%2=0 THEN seq END AS nuc, CASE WHEN n%4=1 THEN seq ELSE '' END AS nucleotides, CASE WHEN n%4=3 THEN seq END AS sequence,
        CASE WHEN n%5<>0 THEN pid END AS processid, CASE WHEN n%5=0 THEN pid END AS process_id,
        CASE WHEN n%2=0 THEN 'BIN:'||species ELSE '' END AS bin_uri, 'BIN:'||species AS bin,
        CASE WHEN n%3=0 THEN mark ELSE '' END AS marker_code, CASE WHEN n%3<>0 THEN mark END AS marker,
        CASE WHEN n%2=0 THEN [lat, lon] END AS coord, coalesce(lat, 1.5::DOUBLE) AS lat, coalesce(lon, 2.5::DOUBLE) AS lon FROM sub""",
    "projected": """SELECT coalesce(nullif(species,''), nullif(species_name,'')) AS species, nullif(genus,'') AS genus, nullif(family,'') AS family,
        nullif("order",'') AS "order", coalesce(nullif(nuc,''), nullif(nucleotides,''), nullif(sequence,'')) AS sequence,
        CASE WHEN len(coord)=2 THEN coord[1] ELSE lat END AS lat, CASE WHEN len(coord)=2 THEN coord[2] ELSE lon END AS lon,
        coalesce(nullif(processid,''), nullif(process_id,'')) AS process_id, coalesce(nullif(bin_uri,''), nullif(bin,'')) AS bin_uri,
        coalesce(nullif(marker_code,''), nullif(marker,'')) AS marker FROM raw""",
    "required": """SELECT * FROM projected WHERE species<>'' AND genus<>'' AND family<>'' AND "order"<>'' AND sequence<>''""",
    "normal": r"""SELECT * REPLACE (upper(regexp_replace(sequence, '^\s+|\s+$', '', 'g')) AS sequence) FROM required""",
    "deduped": "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY species, sequence ORDER BY process_id NULLS LAST) AS rn FROM normal) WHERE rn = 1",
    "banded": "SELECT * FROM deduped WHERE length(sequence) BETWEEN 500 AND 750",
    "cleaned": f"SELECT * FROM banded WHERE {AMBIGUOUS.format('sequence')} <= 0.01",
    "specimens": """SELECT 'V'||vec_id AS process_id, 'sp'||label AS species, 'g'||(label//2) AS genus, 'f'||(label//4) AS family, 'o'||(label//8) AS "order",
        CASE WHEN vec_id%10<>0 THEN ((vec_id*37)%180-90)::DOUBLE END AS lat, CASE WHEN vec_id%10<>0 THEN ((vec_id*53)%360-180)::DOUBLE END AS lon,
        embedding::DOUBLE[] AS vec FROM embeddings""",
}
for _name, _cte in {
    **splits_of("specimens", prefix="s_"),
    **fallback_of("s_rows", 64, "s_"),
    **neighbours_of("s_rows", "s_"),
    **splits_of("clean", prefix="b_"),
    **splits_of("clean", prefix="c_"),
}.items():
    BASE[_name] = _cte

BASE |= {
    "s_preds": "SELECT * FROM s_ours UNION ALL BY NAME SELECT * FROM s_nnlong",
    "s_subsets": "SELECT *, 'all' AS subset FROM s_preds UNION ALL BY NAME SELECT *, 'novel' AS subset FROM s_preds WHERE split='test'",
    "s_correct": "SELECT *, (nearest = truth)::INT AS correct FROM s_ours",
    "s_test": "SELECT * FROM s_correct WHERE split='test'",
}


def bins(rows: str, keys: str, n: int = 10) -> str:
    return f"""SELECT g.*, b.bin_index, b.conf_low, b.conf_high, avg(r.confidence) AS mean_confidence, avg(r.correct::DOUBLE) AS accuracy, count(r.confidence) AS count
        FROM (SELECT DISTINCT {keys} FROM {rows}) g CROSS JOIN (SELECT i AS bin_index, i*(1.0::DOUBLE/{n}) AS conf_low, CASE WHEN i={n - 1} THEN 1.0::DOUBLE ELSE (i+1)*(1.0::DOUBLE/{n}) END AS conf_high FROM range({n}) t(i)) b
        LEFT JOIN {rows} r ON {' AND '.join(f'r.{k.strip()}=g.{k.strip()}' for k in keys.split(','))} AND r.confidence>=b.conf_low AND (r.confidence<b.conf_high OR (b.bin_index={n - 1} AND r.confidence<=b.conf_high))
        GROUP BY ALL"""


BASE["s_bins"] = bins("s_test", "rank")
BASE["s_ece"] = """SELECT rank, n, coalesce(e, 0)/n AS ece FROM (SELECT rank, count(*) n FROM s_test GROUP BY ALL) JOIN
    (SELECT rank, sum(count*abs(accuracy-mean_confidence)) e FROM s_bins GROUP BY ALL) USING (rank)"""


def statement(final: str, extra: dict[str, str] | None = None) -> str:
    """``final`` behind the named pieces it needs, in order of need."""
    table = BASE | (extra or {})
    order: list[str] = []

    def need(text: str):
        for name in re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text):
            if name in table and name not in order and name not in seen:
                seen.add(name)
                need(table[name])
                order.append(name)

    seen: set[str] = set()
    need(final)
    return ("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({table[n]})" for n in order) + "\n" if order else "") + final
