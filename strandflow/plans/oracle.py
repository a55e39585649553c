"""Oracle SQL: named views as a WITH clause in front of each query, with what they need."""

from __future__ import annotations

import re

from strandflow.sources.tracks import NODE, PROB, TRACK, number

VIEWS = {
    "obs": "SELECT l_orderkey c, l_linenumber t, min(l_quantity) q, min(l_partkey) pk, min(l_discount) d, min(l_tax) tx FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "track": f"SELECT {', '.join(TRACK)} FROM obs",
    "nodes": f"SELECT *, z*1.625::double uz, y*0.40625::double uy, x*0.40625::double ux FROM (SELECT {', '.join(NODE)} FROM track WHERE NOT (r=1 AND t<4))",
    "edges": f"""SELECT dataset, source_id*100000000+target_id edge_id, source_id, target_id, CAST({PROB} AS double) edge_prob FROM
 (SELECT a.dataset, a.node_id source_id, b.node_id target_id, a.c a_c, b.c b_c, b.d b_d, b.tx b_tx FROM nodes a JOIN nodes b ON a.dataset=b.dataset AND b.t=a.t+1
  AND ((a.c=b.c AND (a.c+a.t)%11<>0) OR (a.r=0 AND b.c=a.c+1 AND a.t=3)))""",
    "gt_nodes": "SELECT dataset, node_id, c, t, r, z+0.25::double z, y+(c%3) y, x-(t%2) x, (z+0.25::double)*1.625::double uz, (y+(c%3))*0.40625::double uy, (x-(t%2))*0.40625::double ux FROM nodes WHERE floor(c/10)%3=0",
    "gt_edges": "SELECT e.* FROM (SELECT a.dataset, a.node_id source_id, b.node_id target_id FROM gt_nodes a JOIN gt_nodes b ON a.dataset=b.dataset AND b.t=a.t+1 AND (a.c=b.c OR (a.r=0 AND b.c=a.c+1 AND a.t=3))) e",
    "datasets": "SELECT dataset, split_part(dataset,'_',1) prefix, CAST(ds%5 AS int) fold, max(t) n_frames, count(*) n_nodes, count(*)*1.1::double estimated_nodes FROM nodes GROUP BY dataset, ds",
    "outd": "SELECT dataset, source_id node_id, count(*) out_degree FROM edges GROUP BY ALL",
    "ind": "SELECT dataset, target_id node_id, count(*) in_degree FROM edges GROUP BY ALL",
    "deg": "SELECT n.*, coalesce(in_degree,0) in_degree, coalesce(out_degree,0) out_degree FROM nodes n LEFT JOIN ind USING (dataset,node_id) LEFT JOIN outd USING (dataset,node_id)",
    "pair_scores": """SELECT a.dataset, a.t, a.node_id source_id, b.node_id target_id, sqrt((a.uz-b.uz)*(a.uz-b.uz)+(a.uy-b.uy)*(a.uy-b.uy)+(a.ux-b.ux)*(a.ux-b.ux)) dist,
 4.0::double - sqrt((a.uz-b.uz)*(a.uz-b.uz)+(a.uy-b.uy)*(a.uy-b.uy)+(a.ux-b.ux)*(a.ux-b.ux)) + ((a.node_id*7+b.node_id)%5)*0.125::double raw_logit
 FROM nodes a JOIN nodes b ON a.dataset=b.dataset AND b.t=a.t+1 WHERE sqrt((a.uz-b.uz)*(a.uz-b.uz)+(a.uy-b.uy)*(a.uy-b.uy)+(a.ux-b.ux)*(a.ux-b.ux)) <= 12""",
    "probs": "SELECT *, exp(raw_logit-max(raw_logit) OVER w)/sum(exp(raw_logit-mx)) OVER w prob FROM (SELECT *, max(raw_logit) OVER (PARTITION BY dataset,t,target_id) mx FROM pair_scores) WINDOW w AS (PARTITION BY dataset,t,target_id)",
    "peaks": f"""SELECT dataset, t, z, y, x, max(prob) prob FROM (SELECT concat('6bba_', {number('CAST(floor(c/300) AS bigint)')}) dataset, t, CAST((c*31+s)%20 AS int) z, CAST((c*17+s*3)%60 AS int) y, CAST((c*13+s*7)%60 AS int) x,
 0.88::double + (CAST(floor(price) AS bigint) % 1200) * 0.0001::double prob FROM (SELECT l_orderkey c, l_linenumber t, l_suppkey s, min(l_extendedprice) price FROM lineitem GROUP BY ALL)) GROUP BY ALL""",
    "forkpairs": """SELECT dataset, source_id, max(CASE WHEN rn=1 THEN target_id END) c1, max(CASE WHEN rn=2 THEN target_id END) c2, max(CASE WHEN rn=2 THEN edge_id END) e2, max(CASE WHEN rn=1 THEN edge_prob END) p1, max(CASE WHEN rn=2 THEN edge_prob END) p2
 FROM (SELECT *, row_number() OVER (PARTITION BY dataset,source_id ORDER BY edge_prob DESC, edge_id) rn, count(*) OVER (PARTITION BY dataset,source_id) n FROM edges) WHERE n=2 GROUP BY dataset, source_id""",
    "forkvec": "SELECT f.*, p.t, a.uz-p.uz az, a.uy-p.uy ay, a.ux-p.ux ax, b.uz-p.uz bz, b.uy-p.uy byy, b.ux-p.ux bx, a.uz-b.uz sz, a.uy-b.uy sy, a.ux-b.ux sx FROM forkpairs f JOIN nodes p ON f.dataset=p.dataset AND f.source_id=p.node_id JOIN nodes a ON f.dataset=a.dataset AND f.c1=a.node_id JOIN nodes b ON f.dataset=b.dataset AND f.c2=b.node_id",
    "forkdist": "SELECT *, sqrt(az*az+ay*ay+ax*ax) d1, sqrt(bz*bz+byy*byy+bx*bx) d2, sqrt(sz*sz+sy*sy+sx*sx) sep, az*bz+ay*byy+ax*bx dp FROM forkvec",
    "forks": "SELECT dataset, source_id, t, c1, c2, e2, p1, p2, d1, d2, sep, CASE WHEN d1*d2>0 THEN degrees(acos(least(greatest(dp/(d1*d2),-1.0::double),1.0::double))) ELSE 'nan'::double END angle, greatest(d1,d2) arm, abs(d1-d2)/greatest(d1+d2,1e-12::double) balance FROM forkdist",
    "passing": "SELECT *, p2>=0.8 AND sep>=6 AND (NOT isnan(angle) AND angle>=120) AND arm<=8 AND balance<=0.5 accepted FROM forks",
    "g2_edges": "SELECT * FROM edges WHERE (dataset, edge_id) NOT IN (SELECT (dataset, e2) FROM passing WHERE NOT accepted)",
}


VIEWS["comp"] = """SELECT dataset, node_id, node_id component FROM deg WHERE in_degree=0
 UNION ALL SELECT e.dataset, e.target_id, c.component FROM comp c JOIN edges e ON e.dataset=c.dataset AND e.source_id=c.node_id"""
VIEWS["g2comp"] = """SELECT n.dataset, n.node_id, n.node_id component FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM g2_edges e WHERE e.dataset=n.dataset AND e.target_id=n.node_id)
 UNION ALL SELECT e.dataset, e.target_id, c.component FROM g2comp c JOIN g2_edges e ON e.dataset=c.dataset AND e.source_id=c.node_id"""
VIEWS["g2kept"] = "SELECT n.dataset, n.node_id FROM (SELECT *, count(*) OVER (PARTITION BY dataset,component) size FROM g2comp) c JOIN nodes n USING (dataset,node_id) WHERE size>9 OR high_conf"
VIEWS["compsize"] = "SELECT dataset, component, count(*) size FROM comp GROUP BY ALL"


VIEWS |= {
    # the graph after the division filter and confidence pruning
    "k9nodes": "SELECT n.* FROM nodes n JOIN g2kept USING (dataset,node_id)",
    "k9edges": "SELECT e.* FROM g2_edges e JOIN g2kept a ON a.dataset=e.dataset AND a.node_id=e.source_id JOIN g2kept b ON b.dataset=e.dataset AND b.node_id=e.target_id",
    "k9deg": """SELECT n.*, coalesce(i.k,0) in_degree, coalesce(o.k,0) out_degree FROM k9nodes n LEFT JOIN (SELECT dataset, target_id node_id, count(*) k FROM k9edges GROUP BY ALL) i USING (dataset,node_id)
 LEFT JOIN (SELECT dataset, source_id node_id, count(*) k FROM k9edges GROUP BY ALL) o USING (dataset,node_id)""",
    # matching of annotations to detections: the components of the radius graph, every assignment of each, the cheapest one
    "mp": """SELECT *, dist + (gt_id%1009)*(node_id%997)%1013*1e-10::double AS cost FROM (SELECT g.dataset, g.t, g.node_id gt_id, n.node_id, sqrt((g.uz-n.uz)*(g.uz-n.uz)+(g.uy-n.uy)*(g.uy-n.uy)+(g.ux-n.ux)*(g.ux-n.ux)) dist
 FROM gt_nodes g JOIN nodes n ON g.dataset=n.dataset AND g.t=n.t) WHERE dist<=7""",
    "mreach": """SELECT DISTINCT dataset, gt_id, gt_id AS root FROM mp UNION SELECT r.dataset, b.gt_id, r.root FROM mreach r JOIN mp a ON a.dataset=r.dataset AND a.gt_id=r.gt_id
 JOIN mp b ON b.dataset=a.dataset AND b.node_id=a.node_id""",
    "mord": "SELECT *, row_number() OVER (PARTITION BY dataset,comp ORDER BY gt_id) k, count(*) OVER (PARTITION BY dataset,comp) n FROM (SELECT dataset, gt_id, min(root) comp FROM mreach GROUP BY ALL)",
    "mchoice": "SELECT dataset, gt_id, node_id, cost FROM mp UNION ALL SELECT DISTINCT dataset, gt_id, -1, 7.0001::double FROM mp",
    "menum": """SELECT DISTINCT dataset, comp, n, 0::bigint AS k, []::bigint[] AS picks, 0.0::double AS cost FROM mord UNION ALL SELECT m.dataset, m.comp, m.n, m.k+1, list_append(m.picks, c.node_id), m.cost+c.cost FROM menum m
 JOIN mord o ON o.dataset=m.dataset AND o.comp=m.comp AND o.k=m.k+1 JOIN mchoice c ON c.dataset=o.dataset AND c.gt_id=o.gt_id WHERE c.node_id=-1 OR NOT list_contains(m.picks, c.node_id)""",
    "matches": """SELECT o.dataset, p.t, o.gt_id, p.node_id, p.dist FROM (SELECT *, row_number() OVER (PARTITION BY dataset,comp ORDER BY cost) rk FROM menum WHERE k=n) b
 JOIN mord o ON o.dataset=b.dataset AND o.comp=b.comp JOIN mp p ON p.dataset=o.dataset AND p.gt_id=o.gt_id AND p.node_id=b.picks[o.k] WHERE rk=1""",
    "kids": "SELECT dataset, source_id gt_id, count(*) children FROM gt_edges GROUP BY ALL",
    "shows": """SELECT g.dataset, g.source_id gt_id, g.target_id daughter, unnest(list_append(a.after, g.target_id)) shown FROM gt_edges g JOIN kids k ON k.dataset=g.dataset AND k.gt_id=g.source_id AND children=2
 LEFT JOIN (SELECT dataset, source_id, list(target_id) AS after FROM gt_edges GROUP BY ALL) a ON a.dataset=g.dataset AND a.source_id=g.target_id""",
}
MATERIALIZED = {"nodes", "edges", "matches", "mp", "mord", "gt_nodes", "gt_edges", "k9nodes", "k9edges", "k9deg", "probs", "pair_scores", "peaks", "single9", "frozen_edges", "frozen_nodes", "bridged", "fedges"}


def verdicts(edges: str) -> str:
    """The verdict on each fork of an edge view, as metrics.division_accounting gives it."""
    return f"""(WITH jd AS (SELECT f.dataset, f.source_id, m.gt_id, coalesce(c.children,0) children FROM (SELECT dataset, source_id FROM {edges} GROUP BY ALL HAVING count(*)>=2) f
  LEFT JOIN matches m ON m.dataset=f.dataset AND m.node_id=f.source_id LEFT JOIN kids c ON c.dataset=m.dataset AND c.gt_id=m.gt_id),
 br AS (SELECT j.*, e.target_id branch FROM jd j JOIN {edges} e ON e.dataset=j.dataset AND e.source_id=j.source_id WHERE children=2),
 seen AS (SELECT br.*, branch AS node_id FROM br UNION ALL SELECT br.*, e.target_id FROM br JOIN {edges} e ON e.dataset=br.dataset AND e.source_id=branch),
 good AS (SELECT s.dataset, s.source_id FROM seen s JOIN matches m ON m.dataset=s.dataset AND m.node_id=s.node_id JOIN shows w ON w.dataset=s.dataset AND w.gt_id=s.gt_id AND w.shown=m.gt_id
  GROUP BY ALL HAVING count(DISTINCT daughter)=2 AND count(DISTINCT branch)=2)
 SELECT jd.*, CASE WHEN good.source_id IS NOT NULL THEN 'tp' WHEN children>0 THEN 'fp' ELSE 'not_evaluated' END verdict FROM jd LEFT JOIN good USING (dataset,source_id))"""


def edge_counts(edges: str) -> str:
    return f"""(SELECT dataset, coalesce(tp,0) tp, coalesce(fp,0) fp, coalesce(n,0)-coalesce(tp,0) fn FROM (SELECT dataset, count(*) n FROM gt_edges GROUP BY 1) FULL JOIN
 (SELECT e.dataset, count(g.source_id) tp, count(*) FILTER (WHERE g.source_id IS NULL) fp FROM {edges} e LEFT JOIN matches a ON a.dataset=e.dataset AND a.node_id=e.source_id LEFT JOIN matches b ON b.dataset=e.dataset AND b.node_id=e.target_id
 LEFT JOIN gt_edges g ON g.dataset=e.dataset AND g.source_id=a.gt_id AND g.target_id=b.gt_id WHERE a.gt_id IS NOT NULL OR b.gt_id IS NOT NULL GROUP BY 1) USING (dataset))"""


def division_counts(edges: str) -> str:
    return f"""(SELECT dataset, coalesce(tp,0) tp, coalesce(fp,0) fp, coalesce(n,0)-coalesce(tp,0) fn FROM (SELECT dataset, count(*) n FROM kids WHERE children=2 GROUP BY 1) FULL JOIN
 (SELECT dataset, count(*) FILTER (WHERE verdict='tp') tp, count(*) FILTER (WHERE verdict='fp') fp FROM {verdicts(edges)} v GROUP BY 1) USING (dataset))"""


def records(edges: str) -> str:
    """One record of metrics per dataset for an edge view over all detections."""
    return f"""(SELECT *, CASE WHEN tp+fp+fn>0 THEN tp*1.0::double/(tp+fp+fn) ELSE 0 END edge_jaccard, n_nodes/estimated-1 node_ratio, greatest(0.0::double, CASE WHEN tp+fp+fn>0 THEN tp*1.0::double/(tp+fp+fn) ELSE 0 END*(1-0.1::double*(n_nodes/estimated-1))) adjusted,
  CASE WHEN gt_nodes>0 THEN matched*1.0::double/gt_nodes ELSE 0 END node_recall FROM (SELECT s.dataset, s.prefix, s.fold, s.n_nodes, s.estimated_nodes*0.95::double estimated, coalesce(a.tp,0) tp, coalesce(a.fp,0) fp, coalesce(a.fn,0) fn,
  coalesce(v.tp,0) division_tp, coalesce(v.fp,0) division_fp, coalesce(v.fn,0) division_fn, coalesce(q.n,0) gt_nodes, coalesce(m.n,0) matched FROM datasets s LEFT JOIN {edge_counts(edges)} a USING (dataset) LEFT JOIN {division_counts(edges)} v USING (dataset)
  LEFT JOIN (SELECT dataset, count(*) n FROM gt_nodes GROUP BY 1) q USING (dataset) LEFT JOIN (SELECT dataset, count(*) n FROM matches GROUP BY 1) m USING (dataset)))"""


def greedy(cands: str) -> str:
    """Candidates (dataset, ord, res: names of resources) with ok: whether a loop by ord that serves each resource once takes them."""
    return f"""(WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY ord) i FROM ({cands})),
 r AS (SELECT DISTINCT dataset, 0::bigint AS i, []::varchar[] AS used, false AS ok FROM c UNION ALL
  SELECT r.dataset, c.i, CASE WHEN list_has_any(r.used, c.res) THEN r.used ELSE list_concat(r.used, c.res) END, NOT list_has_any(r.used, c.res) FROM r JOIN c ON c.dataset=r.dataset AND c.i=r.i+1)
 SELECT c.*, r.ok FROM r JOIN c USING (dataset,i))"""


def with_views(query: str) -> str:
    """The query with the views that it needs, directly or through others, in order."""
    need: dict[str, bool] = {}
    order: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in need and re.search(rf"\b{name}\b", text):
                need[name] = True
                visit(VIEWS[name])
                order.append(name)

    visit(query)
    return ("WITH RECURSIVE " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in MATERIALIZED else ''}({VIEWS[n]})" for n in order) + "\n" if order else "") + query
