"""DuckDB SQL of the registered queries; fixtures are the same views in DuckDB's words."""

from __future__ import annotations

import re

from stratacut.sources import fixtures as fx

# Fixed values, written out here so that the SQL doesn't depend on the library's own tables: limits and colours of the presets for 2 to 12
# layers, the stack's colours, and the blur's weights of radius 2 and 3.
LIMITS = {
    2: (90, 90),
    3: (85, 85, 138),
    4: (60, 60, 100, 150),
    5: (50, 50, 90, 130, 170),
    6: (40, 40, 70, 100, 130, 160),
    7: (30, 30, 60, 90, 120, 150, 180),
    8: (30, 30, 50, 75, 100, 130, 160, 190),
    9: (20, 20, 45, 70, 95, 120, 145, 170, 190),
    10: (15, 15, 45, 70, 95, 120, 145, 165, 180, 195),
    11: (20, 20, 40, 60, 80, 100, 120, 140, 160, 180, 200),
    12: (10, 10, 20, 40, 60, 80, 100, 120, 140, 160, 180, 200),
}
COLOURS = {
    2: ("#000000", "#FFFFFF"),
    3: ("#000000", "#7F7F7F", "#FFFFFF"),
    4: ("#000000", "#525252", "#A0A0A0", "#FFFFFF"),
    5: ("#000000", "#434343", "#7F7F7F", "#B2B2B2", "#FFFFFF"),
    6: ("#000000", "#3D3D3D", "#676767", "#848484", "#B2B2B2", "#FFFFFF"),
    7: ("#000000", "#313131", "#585858", "#7C7C7C", "#B0B0B0", "#CBCBCB", "#FFFFFF"),
    8: ("#000000", "#2B2B2B", "#484848", "#5F5F5F", "#7C7C7C", "#B0B0B0", "#CBCBCB", "#FFFFFF"),
    9: ("#000000", "#202020", "#505050", "#646464", "#818181", "#A7A7A7", "#C2C2C2", "#D5D5D5", "#FFFFFF"),
    10: ("#000000", "#262626", "#3F3F3F", "#505050", "#6C6C6C", "#8B8B8B", "#ABABAB", "#C4C4C4", "#DFDFDF", "#FFFFFF"),
    11: ("#000000", "#1D1D1D", "#303030", "#4A4A4A", "#5B5B5B", "#808080", "#9E9E9E", "#BABABA", "#D0D0D0", "#E3E3E3", "#FFFFFF"),
    12: ("#000000", "#1B1B1B", "#313131", "#3E3E3E", "#5A5A5A", "#676767", "#7C7C7C", "#9E9E9E", "#BABABA", "#D0D0D0", "#E3E3E3", "#FFFFFF"),
}
STACK = ("#0f0f0f", "#2a1f3d", "#4a3560", "#6b5080", "#9b7fa8", "#c4aed0", "#ddd0e8", "#f0eaf6")
WEIGHTS = {
    2: (0.054488684982061386, 0.24420134723186493, 0.40261995792388916, 0.24420134723186493, 0.054488684982061386),
    3: (0.03663284704089165, 0.11128075420856476, 0.2167453169822693, 0.270682156085968, 0.2167453169822693, 0.11128075420856476, 0.03663284704089165),
}


def limits(n: int) -> tuple[int, ...]:
    """Of a preset, or an even split in whole numbers that ends in 255."""
    return LIMITS.get(n) or tuple((510 * k + n) // (2 * n) for k in range(1, n)) + (255,)


def preset_colours(n: int) -> tuple[str, ...]:
    return COLOURS.get(n) or ("#333",) * n


THUMBS, SWATCHES, POSTERS, RINGS = (f"({x})" for x in (fx.THUMBS_DUCK, fx.SWATCHES_DUCK, fx.POSTERS_DUCK, fx.RINGS_DUCK))
URLS, EDITS = f"({fx.URLS_DUCK})", f"({fx.EDITS_DUCK})"
LUMA = "cast(floor(0.299::DOUBLE*r + 0.587::DOUBLE*g + 0.114::DOUBLE*b + 0.5::DOUBLE) as int)"


def values(ns: list[int]) -> str:
    return "(values " + ",".join(f"({n},{k},{v})" for n in ns for k, v in enumerate(limits(n))) + ") t(n_layers, layer_id, upper)"


FOUR = values([4])
BANDS = f"(select n_layers, layer_id, upper, coalesce(lag(upper) over (partition by n_layers order by layer_id), 0) lower from {FOUR})"
INSIDE = "case when layer_id = 0 then luma < upper else luma >= upper end"
STACK_SQL = "list_value(" + ",".join(f"'{c}'" for c in STACK) + ")"


def lit(view: str) -> str:
    return f"(select *, {LUMA} luma from {view})"


def masks(view: str) -> str:
    return f"(select image_id, layer_id, x, y from {lit(view)} p join {FOUR} on {INSIDE} where a >= 10)"


def colours(view: str) -> str:
    return f"""(select i.image_id, t.layer_id, coalesce(c.r,0) r, coalesce(c.g,0) g, coalesce(c.b,0) b
 from (select distinct image_id from {view}) i cross join {FOUR} left join
 (select image_id, layer_id, cast(floor(sum(r)/count(*)+0.5) as int) r, cast(floor(sum(g)/count(*)+0.5) as int) g, cast(floor(sum(b)/count(*)+0.5) as int) b
  from {lit(view)} p join {BANDS} bb on lower <= luma and luma < upper where a >= 10 group by 1,2) c using (image_id, layer_id))"""


def preview(view: str) -> str:
    return f"""with m as (select image_id, x, y, max(layer_id) layer_id from {masks(view)} group by 1,2,3)
select image_id, '#' || printf('%02x%02x%02x', r, g, b) color, count(*) n_pixels from m join {colours(view)} c using (image_id, layer_id) group by 1,2"""


def runs(mask: str) -> str:
    return f"(select image_id, layer_id, y, min(x) x0, max(x) x1 from (select *, x - row_number() over (partition by image_id, layer_id, y order by x) g from {mask}) group by image_id, layer_id, y, g)"


DARK = f"(select image_id, 0 layer_id, x, y from {lit(SWATCHES)} where a >= 10 and luma < 100)"
DARK_THUMBS = f"(select image_id, 0 layer_id, x, y from {lit(THUMBS)} where a >= 10 and luma < 100)"


def reach(where: str) -> str:
    """Labels of 4-connected components of 8x8 pictures as view ``l``: (image_id, idx, comp_id)."""
    return f"""p as (select image_id, y*8+x idx, x, y from {lit(THUMBS)} where {where}),
e as (select a.image_id, a.idx i, b.idx j from p a join p b on a.image_id=b.image_id and abs(a.x-b.x)+abs(a.y-b.y)=1),
w as (select image_id, idx i, idx j from p union select w.image_id, w.i, e.j from w join e on w.image_id=e.image_id and w.j=e.i),
l as (select image_id, i idx, min(j) comp_id from w group by 1,2)"""


def weights(radius: int) -> list[str]:
    return [f"{w!r}::DOUBLE" for w in WEIGHTS[radius]]


def blur_pass(v: str, along: str, across: str, radius: int) -> str:
    terms = ["0.0::DOUBLE"]
    w = f"(partition by image_id, {across} order by {along})"
    whole = f"(partition by image_id, {across} order by {along} rows between unbounded preceding and unbounded following)"
    for k, weight in enumerate(weights(radius)):
        d = k - radius
        x = v if d == 0 else f"coalesce(lag({v},{-d}) over {w}, first({v}) over {whole})" if d < 0 else f"coalesce(lead({v},{d}) over {w}, last({v}) over {whole})"
        terms.append(f"cast({x} as double)*{weight}")
    return "(" * (len(terms) - 1) + terms[0] + "".join(f" + {t})" for t in terms[1:])


SEEDS = f"""seeds as (select image_id, cast(n-1 as int) k, r, g, b from (select *, row_number() over (partition by image_id order by x, r, g, b) n from {THUMBS} where a >= 10 and y = 0) where n <= 3)"""
NEAR = f"""near as (select image_id, x, y, arg_min(k, (d*10+k)) k, any_value(r) r, any_value(g) g, any_value(b) b from (
 select p.image_id, p.x, p.y, s.k, p.r, p.g, p.b, (p.r-s.r)*(p.r-s.r)+(p.g-s.g)*(p.g-s.g)+(p.b-s.b)*(p.b-s.b) d from {THUMBS} p join seeds s using (image_id) where p.a >= 10) group by 1,2,3)"""
EDGES = f"""e as (select *, coalesce(lead(x) over w, first(x) over f) nx, coalesce(lead(y) over w, first(y) over f) ny from {RINGS}
 window w as (partition by doc_id, contour_id order by seq), f as (partition by doc_id, contour_id order by seq rows between unbounded preceding and unbounded following))"""
AREAS = f"{EDGES}, ar as (select doc_id, contour_id, count(*) n, abs(sum(x*ny-nx*y))/2 area from e group by 1,2), ro as (select *, case when count(*) over (partition by doc_id) > 1 then case when row_number() over (partition by doc_id order by area desc, contour_id) = 1 then 'mainland' else 'island' end end as role from ar)"
CANDS = f"""{AREAS}, c0 as (select i.doc_id, i.contour_id, m.contour_id mainland, i.seq, m.seq edge, i.x, i.y, m.x ax, m.y ay, m.nx bx, m.ny \"by\"
 from e i join ro a on i.doc_id=a.doc_id and i.contour_id=a.contour_id and a.role='island' join ro b on b.doc_id=i.doc_id and b.role='mainland' join e m on m.doc_id=b.doc_id and m.contour_id=b.contour_id),
 c1 as (select *, bx-ax dx, "by"-ay dy from c0), c2 as (select *, case when dx*dx+dy*dy=0 then 0 else greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((x-ax)*dx+(y-ay)*dy)/(dx*dx+dy*dy))) end t from c1),
 c3 as (select *, ax+t*dx fx, ay+t*dy fy from c2), cand as (select *, round((x-fx)*(x-fx)+(y-fy)*(y-fy), 9) d2 from c3)"""
CROSS = "case when abs(det) < 1e-10 then false else (wx*vy-wy*vx)/det > {m} and (wx*vy-wy*vx)/det < 1-{m} and (wx*uy-wy*ux)/det > {m} and (wx*uy-wy*ux)/det < 1-{m} end"
NUM = "regexp_replace(regexp_replace(case when floor({v}*100+0.5) < 0 then '-' else '' end || cast(cast(abs(floor({v}*100+0.5)) as bigint)//100 as varchar) || '.' || lpad(cast(cast(abs(floor({v}*100+0.5)) as bigint)%100 as varchar),2,'0'), '0+$', ''), '\\.$', '')"


def path(view: str) -> str:
    return f"(select doc_id, contour_id, 'M ' || string_agg({NUM.format(v='x')} || ' ' || {NUM.format(v='y')}, ' L ' order by seq) || ' Z' d from {view} group by 1,2)"


SVGS = f"""(select doc_id, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 1000 1000" width="1000" height="1000">' || string_agg('<path d="' || d || '" fill="black"/>', '' order by contour_id) || '</svg>' svg from {path(RINGS)} group by 1)"""
HOLES = f"""with recursive {reach("luma < 100")}, f as (select image_id, comp_id, count(*) area, bool_or(idx%8 in (0,7) or idx//8 in (0,7)) t from l group by 1,2),
ink as (select image_id, x, y from {lit(THUMBS)} where luma >= 100)
select image_id, x, y from ink union select l.image_id, l.idx%8, l.idx//8 from l join f using (image_id, comp_id) where area < 4 and not t and l.image_id in (select image_id from ink)"""
BOXES = f"(select image_id, layer_id, x0, x1, min(y) y0, max(y) y1 from (select *, y - row_number() over (partition by image_id, layer_id, x0, x1 order by y) g from {{r}}) group by image_id, layer_id, x0, x1, g)"
ANGLE = "(atan2(y-11.25::DOUBLE, x-11.5::DOUBLE)+pi())"


def away(c: str) -> str:
    return f"(case when abs({ANGLE}-{c}) > pi() then 2*pi()-abs({ANGLE}-{c}) else abs({ANGLE}-{c}) end)"


MARKS = "".join(
    f'<line x1="{cx - dx}" y1="{cy - dy}" x2="{cx + dx}" y2="{cy + dy}" stroke="black" stroke-width="2" stroke-linecap="round"/>'
    for cx, cy in ((10, 10), (38, 10), (10, 38), (38, 38))
    for dx, dy in ((12, 0), (0, 12))
)
SIZE = "(select image_id, max(x)+1 width, max(y)+1 height from {v} group by 1)"
LIVE = f"ev as (select * from {EDITS}), rs as (select session_id, max((ts, event_id)) r from ev where setting='reset' group by 1), lv as (select ev.* from ev left join rs using (session_id) where setting <> 'reset' and (r is null or (ts, event_id) > r))"

def presets(ns: range) -> str:
    return "(values " + ",".join(f"({n},{k},{v},'{c}')" for n in ns for k, (v, c) in enumerate(zip(limits(n), preset_colours(n), strict=True))) + ") t(n_layers, layer_id, upper, color)"


def reached(name: str, cells: str) -> str:
    """Components of (image_id, layer_id, idx) of 8x8 pictures as view ``name``: (image_id, layer_id, idx, comp_id)."""
    return f"""{name}_e as (select a.image_id, a.layer_id, a.idx i, b.idx j from {cells} a join {cells} b on a.image_id=b.image_id and a.layer_id=b.layer_id and abs(a.idx%8-b.idx%8)+abs(a.idx//8-b.idx//8)=1),
{name}_w as (select image_id, layer_id, idx i, idx j from {cells} union select w.image_id, w.layer_id, w.i, e.j from {name}_w w join {name}_e e on w.image_id=e.image_id and w.layer_id=e.layer_id and w.j=e.i),
{name} as materialized (select image_id, layer_id, i idx, min(j) comp_id from {name}_w group by 1,2,3)"""


SQUARE = "({a}.r-{b}.r)*({a}.r-{b}.r)+({a}.g-{b}.g)*({a}.g-{b}.g)+({a}.b-{b}.b)*({a}.b-{b}.b)"


def palette(n: int, rounds: int, only: str = "true") -> str:
    """Views pal0 ... pal<rounds> (image_id, k, r, g, b) of the 8x8 pictures: farthest seeds and Lloyd's rounds.

    ``only``: a condition on image_id for seed {k} after the first.
    """
    parts = [f"px as materialized (select image_id, y*8+x idx, cast(r as double) r, cast(g as double) g, cast(b as double) b from {THUMBS} where a >= 10)", "s0 as materialized (select image_id, 0 k, r, g, b from (select *, row_number() over (partition by image_id order by idx) n from px) where n=1)"]
    for k in range(1, n):
        parts.append(f"""s{k} as materialized (select * from s{k - 1} union all select image_id, {k}, r, g, b from (select *, row_number() over (partition by image_id order by d desc, idx) n from
 (select p.image_id, p.idx, any_value(p.r) r, any_value(p.g) g, any_value(p.b) b, min({SQUARE.format(a="p", b="s")}) d from px p join s{k - 1} s using (image_id) group by 1,2)) where n=1 and d > 0 and {only.format(k=k)})""")
    parts.append(f"pal0 as (select * from s{n - 1})")
    for j in range(1, rounds + 1):
        parts.append(f"""pal{j} as materialized (select s.image_id, s.k, coalesce(mr,s.r) r, coalesce(mg,s.g) g, coalesce(mb,s.b) b from pal{j - 1} s left join (select image_id, k, sum(r)/count(*) mr, sum(g)/count(*) mg, sum(b)/count(*) mb from
 (select *, row_number() over (partition by image_id, idx order by d, k) n from (select p.*, s.k, {SQUARE.format(a="p", b="s")} d from px p join pal{j - 1} s using (image_id))) where n=1 group by 1,2) m using (image_id, k))""")
    parts.append(f"pal as materialized (select image_id, k, cast(floor(r+0.5) as int) r, cast(floor(g+0.5) as int) g, cast(floor(b+0.5) as int) b from pal{rounds})")
    return ",\n".join(parts)


def drawn(*parts: str) -> str:
    """52 bits of the md5 of parts, as a number from 0 to under 1."""
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 13))::bigint::double / 4503599627370496.0::DOUBLE)"


def weighted_seeds(n: int) -> str:
    """Views ws1 ... ws<n>: seeds of 8x8 pictures drawn in proportion to squared distances."""
    parts = [f"px as materialized (select image_id, y*8+x idx, r, g, b from {THUMBS} where a >= 10)", f"ws1 as materialized (select image_id, 0 k, r, g, b from (select *, row_number() over (partition by image_id order by {drawn('0', 'image_id', 'idx', '0')}, idx) n from px) where n=1)"]
    for k in range(1, n):
        parts.append(f"""ws{k + 1} as materialized (select * from ws{k} union all select image_id, {k}, r, g, b from (select *, row_number() over (partition by image_id order by -ln(greatest({drawn('0', 'image_id', 'idx', str(k))}, 1e-300)) / d2, idx) n from
 (select p.image_id, p.idx, any_value(p.r) r, any_value(p.g) g, any_value(p.b) b, min({SQUARE.format(a="p", b="s")}) d2 from px p join ws{k} s using (image_id) group by 1,2) where d2 > 0) where n=1)""")
    return ",\n".join(parts)


def corpus_palette(n: int, draws: int, many: int, rounds: int) -> str:
    """Views cw (weighted colours), cj<draws> (joined), cc<n> (seeds) and cp<rounds> (palette) of all 8x8 pictures together."""
    parts = [f"cw as materialized (select r, g, b, count(*) w from {THUMBS} where a >= 10 group by all)", f"cj0 as materialized (select r, g, b from cw order by {drawn('0', 'r', 'g', 'b')} / w, r, g, b limit 1)"]
    for j in range(1, draws + 1):
        parts.append(f"""cd{j} as materialized (select p.r, p.g, p.b, any_value(p.w) * min({SQUARE.format(a="p", b="s")}) d from cw p, cj{j - 1} s group by 1,2,3),
cj{j} as materialized (select * from cj{j - 1} union select r, g, b from cd{j}, (select sum(d) total from cd{j}) where {drawn('0', 'r', 'g', 'b', str(j))} * total::double < d::double * {many}.0::DOUBLE)""")
    near = f"(select p.*, s.r sr, s.g sg, s.b sb, row_number() over (partition by p.r, p.g, p.b order by {SQUARE.format(a='p', b='s')}, s.r, s.g, s.b) n from cw p, cj{draws} s)"
    parts.append(f"cq as materialized (select sr r, sg g, sb b, sum(w) w from {near} where n=1 group by 1,2,3)")
    parts.append("cc1 as materialized (select 0 k, r, g, b from (select * from cq order by w desc, r, g, b limit 1))")
    for k in range(1, n):
        parts.append(f"""cc{k + 1} as materialized (select * from cc{k} union all (select {k}, r, g, b from (select q.r, q.g, q.b, any_value(q.w) * min({SQUARE.format(a="q", b="s")}) v from cq q, cc{k} s group by 1,2,3) where v > 0 order by v desc, r, g, b limit 1))""")
    parts.append(f"cp0 as (select k, r::double r, g::double g, b::double b from cc{n})")
    for j in range(1, rounds + 1):
        parts.append(f"""cp{j} as materialized (select s.k, coalesce(m.r, s.r) r, coalesce(m.g, s.g) g, coalesce(m.b, s.b) b from cp{j - 1} s left join (select k, sum(r*w)::double/sum(w)::double r, sum(g*w)::double/sum(w)::double g, sum(b*w)::double/sum(w)::double b from
 (select p.*, s.k, row_number() over (partition by p.r, p.g, p.b order by {SQUARE.format(a="p", b="s")}, s.k) n from cw p, cp{j - 1} s) where n=1 group by k) m using (k))""")
    return ",\n".join(parts)


BEST = f"""{CANDS}, j as (select c.doc_id, c.contour_id, c.seq, c.edge, fx-c.x ux, fy-c.y uy, w.nx-w.x vx, w.ny-w.y vy, w.x-c.x wx, w.y-c.y wy from cand c join e w on w.doc_id=c.doc_id and w.contour_id<>c.contour_id and w.contour_id<>c.mainland),
kk as (select *, ux*vy-uy*vx det from j), bad as (select distinct doc_id, contour_id, seq, edge from kk where {CROSS.format(m='1e-4::DOUBLE')}),
best as (select * from (select *, row_number() over (partition by doc_id, contour_id order by d2, seq, edge) n from cand anti join bad using (doc_id, contour_id, seq, edge)) where n=1)"""


def corners(view: str) -> str:
    return f"""q as (select *, fx-x px, fy-y py, sqrt((fx-x)*(fx-x)+(fy-y)*(fy-y)) len from {view}), box as (select *, -py/len*(3.0::DOUBLE/2) ox, px/len*(3.0::DOUBLE/2) oy from q where len >= 1e-6),
corner as (select doc_id, contour_id, x+ox x0, y+oy y0, fx+ox x1, fy+oy y1, fx-ox x2, fy-oy y2, x-ox x3, y-oy y3 from box)"""


STATE = f"""e0 as (select session_id, event_id, ts, layer_id, value v0, setting s0, ((value%3)+3)%3 m from {EDITS}),
ev as (select session_id, event_id, ts, layer_id, case when s0='blur' and m=0 then 'layers' when s0='blur' and m=1 then 'mode' else s0 end setting,
 cast(case when s0='blur' and m=0 then ((v0%13)+13)%13+2 when s0='blur' and m=1 then event_id%2 else v0 end as int) value from e0),
es as (select distinct session_id, cast(session_id%19 as int)+2 n_colors from ev where session_id%2=0),
rs as (select session_id, max((ts, event_id)) r from ev where setting='reset' group by 1),
lv as (select ev.*, n_colors from ev left join rs using (session_id) left join es using (session_id) where setting <> 'reset' and (r is null or (ts, event_id) > r)),
st as (select s.session_id, case when m.mode=1 then 'cartoon' else 'realistic' end as mode, coalesce(m.n, 4) n_layers from (select distinct session_id from ev) s left join
 (select session_id, arg_max(value, (ts, event_id)) filter (where setting='mode') as mode, arg_max(case when setting='layers' then value else n_colors end, (ts, event_id)) filter (where setting='layers' or setting='mode' and value=1 and n_colors is not null) n from lv group by 1) m using (session_id))"""

def line_members(segments: str) -> str:
    """View ln: the pixels (seq, x, y) of segments (image_id, sx, sy, tx, ty) by the error term of the line."""
    dx, dy = "abs(tx-sx)", "abs(ty-sy)"
    return f"""ln as (select image_id, sx, sy, tx, ty, 0 seq, sx x, sy y, {dx}-{dy} err from {segments} union all
 select image_id, sx, sy, tx, ty, seq+1, x + case when 2*err > -{dy} then case when sx < tx then 1 else -1 end else 0 end, y + case when 2*err < {dx} then case when sy < ty then 1 else -1 end else 0 end,
 err - case when 2*err > -{dy} then {dy} else 0 end + case when 2*err < {dx} then {dx} else 0 end from ln where x <> tx or y <> ty)"""


TURN = "(atan2(y-cy, x-cx)+pi())"
OPPOSING = [f"(case when abs({TURN}-{c}) > pi() then 2*pi()-abs({TURN}-{c}) else abs({TURN}-{c}) end)" for c in ("0", "pi()", "(pi()/2)")]
TURNED = [f"(case when abs({TURN}-{c}) > pi() then 2*pi()-abs({TURN}-{c}) else abs({TURN}-{c}) end)" for c in ("0", "(2*pi()/3)", "(4*pi()/3)")]


def spread(name: str, cells: str, width: int) -> str:
    """Components of (image_id, layer_id, idx) as view ``name`` (image_id, layer_id, idx, comp_id): least labels spread until none changes."""
    return f"""{name}_e as materialized (select a.image_id, a.layer_id, a.idx i, b.idx j from {cells} a join {cells} b on a.image_id=b.image_id and a.layer_id=b.layer_id and (abs(a.idx-b.idx)={width} or abs(a.idx-b.idx)=1 and a.idx//{width}=b.idx//{width})),
{name}_w(image_id, layer_id, idx, comp_id) using key (image_id, layer_id, idx) as (select image_id, layer_id, idx, idx from {cells} union
 select c.image_id, c.layer_id, c.idx, min(w.comp_id) from {name}_w w join {name}_e e on e.image_id=w.image_id and e.layer_id=w.layer_id and e.i=w.idx
  join recurring.{name}_w c on c.image_id=w.image_id and c.layer_id=w.layer_id and c.idx=e.j where w.comp_id < c.comp_id group by 1,2,3),
{name} as materialized (select * from {name}_w)"""


def shores(view: str, width: int, layers: str, least: int) -> str:
    """Views mk (ink), hole, kn (facts of mainland and islands) and pt (their boundary points) of the layers that meet ``layers``."""
    return f"""mk as materialized (select image_id, layer_id, y*{width}+x idx from {masks(view)} where {layers}), {banks(view, width, least)}"""


def banks(view: str, width: int, least: int) -> str:
    """Views hole, kn and pt of ``shores`` for a given view mk."""
    return f"""gap as materialized (select p.image_id, l.layer_id, p.y*{width}+p.x idx from {view} p join (select distinct image_id, layer_id from mk) l using (image_id) anti join mk b on b.image_id=p.image_id and b.layer_id=l.layer_id and b.idx=p.y*{width}+p.x), {spread('hole', 'gap', width)},
fa as (select image_id, layer_id, comp_id, count(*) area, avg(idx%{width}) cx, avg(idx//{width}) cy from hole group by 1,2,3),
kn as (select *, n=1 mainland from (select *, row_number() over (partition by image_id, layer_id order by area desc, comp_id) n from fa) where n=1 or area >= {least}),
pt as materialized (select distinct h.image_id, h.layer_id, h.comp_id, h.idx, h.idx%{width} x, h.idx//{width} y, area, mainland, cx, cy from hole h join kn using (image_id, layer_id, comp_id)
 join mk m on m.image_id=h.image_id and m.layer_id=h.layer_id and (abs(m.idx-h.idx)={width} or abs(m.idx-h.idx)=1 and m.idx//{width}=h.idx//{width}))"""


def targets(view: str, width: int, layers: str, to: str = "t.mainland or t.comp_id <> s.comp_id and t.area > s.area") -> str:
    """View ca: sources of three sectors, at most 8 points each, with the nearest point of each component that meets ``to``."""
    return f"{shores(view, width, layers, 2)}, {sources(8, to)}"


THIRDS = f"case when {TURNED[0]} <= {TURNED[1]} and {TURNED[0]} <= {TURNED[2]} then 0 when {TURNED[1]} <= {TURNED[2]} then 1 else 2 end"


def sources(each: int, to: str = "t.mainland or t.comp_id <> s.comp_id and t.area > s.area", sector: str = THIRDS) -> str:
    """View ca of ``targets`` from pt, with at most ``each`` points of a sector."""
    d2 = "((t.x-s.x)*(t.x-s.x)+(t.y-s.y)*(t.y-s.y))*100000+t.idx"
    return f"""se as (select *, {sector} sector from pt where not mainland),
sr as (select *, row_number() over (partition by image_id, layer_id, comp_id, sector order by idx)-1 r, count(*) over (partition by image_id, layer_id, comp_id, sector) n from se),
so as (select * from sr where n <= {each} or list_contains(list_transform(range({each}), lambda i: cast(floor(i*(n/{each}::DOUBLE)) as bigint)), r)),
ca as materialized (select s.image_id, s.layer_id, s.comp_id island, s.area, s.sector, s.x sx, s.y sy, t.comp_id target, t.mainland, arg_min(t.x, {d2}) tx, arg_min(t.y, {d2}) ty
 from so s join pt t on t.image_id=s.image_id and t.layer_id=s.layer_id and ({to}) group by all)"""


def covered(view: str, width: int, layers: str, upper: int, to: str = "t.mainland or t.comp_id <> s.comp_id and t.area > s.area") -> str:
    """View fo: ca with the share of each line under layer ``upper``."""
    return f"""{targets(view, width, layers, to)}, sg as (select distinct image_id, sx, sy, tx, ty from ca), {line_members('sg')},
up as (select image_id, x, y, 1 c from {masks(view)} where layer_id={upper}), cv as (select image_id, sx, sy, tx, ty, count(c)/count(*)::DOUBLE coverage from ln left join up using (image_id, x, y) group by 1,2,3,4,5),
fo as materialized (select * from ca join cv using (image_id, sx, sy, tx, ty))"""


def best_of(columns: str) -> str:
    """The best candidate of each sector of fo without penalties."""
    return f"""le as (select *, sqrt(cast((tx-sx)*(tx-sx)+(ty-sy)*(ty-sy) as double)) len from fo),
sc as (select *, coverage*10000 - len - len*0.1::DOUBLE + case when mainland then 200 else 0 end score, case when coverage >= 0.9 then 0 when coverage >= 0.8 then 1 when coverage >= 0.7 then 2 when coverage >= 0.6 then 3 else 4 end tier from le)
select {columns}, tier, round(score, 6) score from (select *, row_number() over (partition by image_id, layer_id, island, sector order by tier, score desc, sy, sx, mainland desc, target) n from sc) where n=1"""


def crossed(a: str, b: str) -> str:
    """Whether segments a and b (sx, sy, tx, ty) cross inside, margins 0.01."""
    ux, uy, vx, vy = f"({a}.tx-{a}.sx)", f"({a}.ty-{a}.sy)", f"({b}.tx-{b}.sx)", f"({b}.ty-{b}.sy)"
    wx, wy, det = f"({b}.sx-{a}.sx)", f"({b}.sy-{a}.sy)", f"({ux}*{vy}-{uy}*{vx})"
    t, q = f"(({wx}*{vy}-{wy}*{vx})::DOUBLE/{det})", f"(({wx}*{uy}-{wy}*{ux})::DOUBLE/{det})"
    return f"case when {det}=0 then false else {t} > 0.01::DOUBLE and {t} < 0.99::DOUBLE and {q} > 0.01::DOUBLE and {q} < 0.99::DOUBLE end"


def chosen(width: int) -> str:
    """Views cf (candidates of fo with the place n of their island's sector), g (what is placed after n of them) and sl (what is chosen)."""
    points = "c.coverage*10000 - c.len - 500*{near} - 1000*{cross} - c.len*0.1::DOUBLE + case when c.mainland then 200 else 0 end"
    now = points.format(near=f"len(list_filter(g.p, lambda o: o.i=c.island and (c.sx-o.sx)*(c.sx-o.sx)+(c.sy-o.sy)*(c.sy-o.sy) < {16 * width * width}))", cross=f"len(list_filter(g.p, lambda o: {crossed('c', 'o')}))")
    return f"""cf as materialized (select fo.*, n, sqrt(cast((tx-sx)*(tx-sx)+(ty-sy)*(ty-sy) as double)) len, case when coverage >= 0.9 then 0 when coverage >= 0.8 then 1 when coverage >= 0.7 then 2 when coverage >= 0.6 then 3 else 4 end tier
 from fo join (select *, row_number() over (partition by image_id, layer_id order by island, sector) n from (select distinct image_id, layer_id, island, sector from fo)) using (image_id, layer_id, island, sector)),
g as (select distinct image_id, layer_id, 0::bigint n, cast([] as struct(i bigint, sx bigint, sy bigint, tx bigint, ty bigint)[]) p from cf union all
 select c.image_id, c.layer_id, c.n, list_append(any_value(g.p), arg_min(struct_pack(i := c.island::bigint, sx := c.sx::bigint, sy := c.sy::bigint, tx := c.tx::bigint, ty := c.ty::bigint), (c.tier, -({now}), c.sy, c.sx, case when c.mainland then 0 else 1 end, c.target)))
 from g join cf c on c.image_id=g.image_id and c.layer_id=g.layer_id and c.n=g.n+1 group by c.image_id, c.layer_id, c.n),
sl as materialized (select image_id, layer_id, n, p[n].i i, p[n].sx sx, p[n].sy sy, p[n].tx tx, p[n].ty ty from g where n > 0),
pt2 as (select c.image_id, c.layer_id, c.n, c.sx, c.sy, c.tx, c.ty, count(*) filter (where o.i=c.island and (c.sx-o.sx)*(c.sx-o.sx)+(c.sy-o.sy)*(c.sy-o.sy) < {16 * width * width}) near, count(*) filter (where {crossed('c', 'o')}) cross_
 from cf c join sl o on o.image_id=c.image_id and o.layer_id=c.layer_id and o.n < c.n group by all),
listed as materialized (select c.*, s.n is not null selected, {points.format(near="coalesce(k.near, 0)", cross="coalesce(k.cross_, 0)")} score from cf c left join pt2 k using (image_id, layer_id, n, sx, sy, tx, ty)
 left join sl s using (image_id, layer_id, n, sx, sy, tx, ty))"""


def erased(view: str, width: int, canvas: int) -> str:
    """Ink of each layer of mk less the bridges of sl, squares of floor(width / 2) around their lines."""
    half = width // 2
    return f"""s3 as (select distinct image_id, sx::int sx, sy::int sy, tx::int tx, ty::int ty from sl), {line_members('s3').replace('ln as', 'le2 as').replace('from ln where', 'from le2 where')},
st as (select distinct s.image_id, s.layer_id, (l.y+b)*{canvas}+l.x+a idx from sl s join le2 l using (image_id, sx, sy, tx, ty), range(-{half}, {half + 1}) t(a), range(-{half}, {half + 1}) u(b) where l.x+a between 0 and {canvas - 1})
select k.image_id, k.layer_id, count(*) filter (where st.idx is null) ink from mk k left join st on st.image_id=k.image_id and st.layer_id=k.layer_id and st.idx=k.idx group by 1,2"""


def numbered(text: str, k: int) -> str:
    """Views of layer ``k``: the names of line_members and chosen with a number."""
    return re.sub(r"\b(fo|cf|g|sl|pt2|listed|ln)\b", rf"\g<1>{k}", text)


def realistic_stack(n: int, canvas: int, width: int) -> str:
    """Views listed<k> and er<k> (ink that is left) of the layers of mk and ca: each layer covered by what is left of those before it."""
    half, parts = width // 2, []
    for k in range(n):
        under = " union ".join(f"select image_id, idx from er{j}" for j in range(k)) or "select image_id, idx from mk where false"
        lines = line_members(f"sg{k}")
        parts.append(f"""sg{k} as (select distinct image_id, sx, sy, tx, ty from ca where layer_id={k}), {numbered(lines, k)}, up{k} as materialized ({under}),
cv{k} as (select l.image_id, sx, sy, tx, ty, count(u.idx)/count(*)::DOUBLE coverage from ln{k} l left join up{k} u on u.image_id=l.image_id and u.idx=l.y*{canvas}+l.x group by 1,2,3,4,5),
fo{k} as materialized (select * from ca join cv{k} using (image_id, sx, sy, tx, ty) where layer_id={k}), {numbered(chosen(width), k)},
pl{k} as (select distinct image_id, sx::int sx, sy::int sy, tx::int tx, ty::int ty from sl{k}), {numbered(line_members(f"pl{k}"), 100 + k)},
st{k} as (select distinct image_id, (y+b)*{canvas}+x+a idx from ln{100 + k}, range(-{half}, {half + 1}) t(a), range(-{half}, {half + 1}) u(b) where x+a between 0 and {canvas - 1}),
er{k} as materialized (select m.image_id, m.layer_id, m.idx from mk m anti join st{k} s on s.image_id=m.image_id and s.idx=m.idx where m.layer_id={k})""")
    return ",\n".join(parts)


def cleaned(view: str, width: int, radius: int, least: int) -> str:
    """Views sf (blurred pixels) and whole (cells of the four layers without specks and inner holes under ``least`` pixels)."""
    return f"""p0 as (select image_id, x, y, r, g, b, a, luma from {lit(view)}), h0 as (select *, cast({blur_pass('luma', 'x', 'y', radius)} as float) hh from p0),
sf as materialized (select image_id, x, y, r, g, b, a, cast(floor({blur_pass('hh', 'y', 'x', radius)}+0.5) as int) luma from h0), low as (select image_id, max(y) bottom from sf group by 1),
mk0 as materialized (select image_id, layer_id, y*{width}+x idx from sf join {FOUR} on {INSIDE} where a >= 10), {spread('ink0', 'mk0', width)},
big as materialized (select image_id, layer_id, idx from (select *, count(*) over (partition by image_id, layer_id, comp_id) n from ink0) where n >= {least}),
gap0 as materialized (select p.image_id, l.layer_id, p.y*{width}+p.x idx from sf p join (select distinct image_id, layer_id from mk0) l using (image_id) anti join big b on b.image_id=p.image_id and b.layer_id=l.layer_id and b.idx=p.y*{width}+p.x), {spread('hole0', 'gap0', width)},
filled as (select image_id, layer_id, comp_id from hole0 join low using (image_id) group by 1,2,3 having count(*) < {least} and not bool_or(idx%{width} in (0,{width - 1}) or idx//{width} in (0, bottom))),
whole as materialized (select * from big union all select image_id, layer_id, idx from hole0 semi join filled using (image_id, layer_id, comp_id))"""


THUMB_STACK = (THUMBS, 8, "true")
SWATCH_STACK = (SWATCHES, 24, "layer_id < 2")
SIMPLE = f"""{shores(SWATCHES, 24, "layer_id < 2", 0)}, tot as (select image_id, count(*) total from {SWATCHES} group by 1),
ra as materialized (select pt.*, row_number() over (partition by image_id, layer_id, comp_id order by idx)-1 r, count(*) over (partition by image_id, layer_id, comp_id) n, area/total::DOUBLE part from pt join tot using (image_id)),
ho as (select *, case when part > 0.03 then greatest(2, ceil(part*50)) else 1 end k from ra where not mainland and area >= 2),
an as materialized (select h.image_id, h.layer_id, comp_id island, area, cast(b as int) anchor, x sx, y sy from ho h, range(0, 60) t(b) where b < k and r = case when k=1 then n//2 else floor(b/k*n) end),
co as materialized (select h.image_id, h.layer_id, x tx, y ty, min(a) t_order from ra h, range(0, 60) t(a) where mainland and a < greatest(5, n//200) and r = floor((a+0.5::DOUBLE)/greatest(5, n//200)*n) group by all),
sm as materialized (select * from (select a.image_id, a.layer_id, a.island, a.anchor, a.sx, a.sy, h.x tx, h.y ty, h.comp_id target,
  row_number() over (partition by a.image_id, a.layer_id, a.island, a.anchor, a.sx, a.sy order by (h.x-a.sx)*(h.x-a.sx)+(h.y-a.sy)*(h.y-a.sy), h.comp_id, h.idx) n
  from an a join pt h on h.image_id=a.image_id and h.layer_id=a.layer_id and not h.mainland and h.comp_id <> a.island where a.area < 1500) where n=1),
al as (select image_id, layer_id, island, anchor, sx, sy from an anti join sm using (image_id, layer_id, island, anchor, sx, sy)),
li as materialized (select image_id, layer_id, island a, target b from sm union select image_id, layer_id, island, -1 from al),
bo as (select image_id, layer_id, a, b from li union select image_id, layer_id, b, a from li),
gr(image_id, layer_id, node, least) using key (image_id, layer_id, node) as (select distinct image_id, layer_id, a, a from bo union
 select c.image_id, c.layer_id, c.node, min(w.least) from gr w join bo e on e.image_id=w.image_id and e.layer_id=w.layer_id and e.a=w.node
  join recurring.gr c on c.image_id=w.image_id and c.layer_id=w.layer_id and c.node=e.b where w.least < c.least group by 1,2,3),
lo as (select image_id, layer_id, min(node) island from gr where least <> -1 and node <> -1 group by image_id, layer_id, least),
ex as (select l.image_id, l.layer_id, l.island, -1 anchor, x sx, y sy from lo l join ra h on h.image_id=l.image_id and h.layer_id=l.layer_id and h.comp_id=l.island where r = n//2),
sh as (select * from (select a.*, c.tx, c.ty, row_number() over (partition by a.image_id, a.layer_id, a.island, a.anchor, a.sx, a.sy order by (c.tx-a.sx)*(c.tx-a.sx)+(c.ty-a.sy)*(c.ty-a.sy), t_order) n
  from (select * from al union all select * from ex) a join co c using (image_id, layer_id)) where n=1)"""
OUTLINES = f"""m as materialized (select image_id, x, y from {DARK}),
u as materialized (select image_id, x, y, x+1 tx, y ty, 0 kind from m anti join m o on o.image_id=m.image_id and o.x=m.x and o.y=m.y-1
 union all select image_id, x+1, y, x+1, y+1, 1 from m anti join m o on o.image_id=m.image_id and o.x=m.x+1 and o.y=m.y
 union all select image_id, x+1, y+1, x, y+1, 2 from m anti join m o on o.image_id=m.image_id and o.x=m.x and o.y=m.y+1
 union all select image_id, x, y+1, x, y, 3 from m anti join m o on o.image_id=m.image_id and o.x=m.x-1 and o.y=m.y),
nx as materialized (select u.image_id, (u.y*1000+u.x)*4+u.kind code, u.x, u.y, u.kind, arg_min((v.y*1000+v.x)*4+v.kind, (v.kind-u.kind+3)%4) ncode from u join u v on v.image_id=u.image_id and v.x=u.tx and v.y=u.ty group by all),
cn as materialized (select a.image_id, a.code from nx a join nx b on b.image_id=a.image_id and b.ncode=a.code and b.kind <> a.kind),
wk as (select image_id, code first, code cur, 0 n from nx semi join cn using (image_id, code) union all select w.image_id, first, ncode, n+1 from wk w join nx on nx.image_id=w.image_id and nx.code=w.cur and ncode > first),
rg as (select w.image_id, first, row_number() over (partition by w.image_id order by first)-1 contour_id from wk w join nx on nx.image_id=w.image_id and nx.code=w.cur and ncode=first)"""



def leaders(view: str, width: int) -> str:
    """Number of colours of pictures under 5,000 pixels: leaders in raster order, one pixel a step."""
    return f"""with recursive sz as (select image_id, count(*) n from {view} group by 1), px as materialized (select image_id, y*{width}+x idx, r, g, b from {view} where a >= 10 and not (r > 240 and g > 240 and b > 240)),
ld as (select image_id, n, -1 idx, cast([] as struct(r int, g int, b int)[]) l from sz union all
 select d.image_id, n, d.idx+1, case when p.r is null or len(l) >= 20 or len(list_filter(l, lambda c: (p.r-c.r)*(p.r-c.r)+(p.g-c.g)*(p.g-c.g)+(p.b-c.b)*(p.b-c.b) < 7500)) > 0 then l
  else list_append(l, {{'r': p.r, 'g': p.g, 'b': p.b}}) end from ld d left join px p on p.image_id=d.image_id and p.idx=d.idx+1 where d.idx < n-1)
select image_id, cast(greatest(2, least(20, len(l))) as int) n_colors from ld where idx=n-1"""


ORACLES = {
    "v05_simplified": f"""with recursive v as materialized (select * from {RINGS}), part as (select doc_id, contour_id, min(seq) a, max(seq) b from v group by 1,2 union all
 select doc_id, contour_id, unnest([a, k]), unnest([k, b]) from (select doc_id, contour_id, a, b, arg_max(seq, (d, -seq)) k, max(d) d from (select p.*, m.seq,
  case when y.x=x.x and y.y=x.y then sqrt((m.x-x.x)*(m.x-x.x)+(m.y-x.y)*(m.y-x.y)) else abs((m.x-x.x)*(y.y-x.y)-(m.y-x.y)*(y.x-x.x))/sqrt((y.x-x.x)*(y.x-x.x)+(y.y-x.y)*(y.y-x.y)) end d
  from part p join v m on m.doc_id=p.doc_id and m.contour_id=p.contour_id and m.seq > p.a and m.seq < p.b join v x on x.doc_id=p.doc_id and x.contour_id=p.contour_id and x.seq=p.a join v y on y.doc_id=p.doc_id and y.contour_id=p.contour_id and y.seq=p.b) group by 1,2,3,4) where d > 12)
select doc_id, contour_id, count(distinct e) n from (select doc_id, contour_id, unnest([a, b]) e from part) group by 1,2""",
    "b09_b16_choice": f"with recursive {covered(*SWATCH_STACK, 2)}, {chosen(2)} select image_id, layer_id, island, sector, sx, sy, tx, ty, selected, round(score, 6) score from listed",
    "b10_erased": f"with recursive {covered(*SWATCH_STACK, 2)}, {chosen(2)}, {erased(SWATCHES, 2, 24)}",
    "b14_statistics": f"""with recursive {covered(*SWATCH_STACK, 2)}, {chosen(2)}, a as (select image_id, layer_id, count(distinct island) islands, count(*) filter (where selected) made, avg(coverage) filter (where selected) cov, avg(len) filter (where selected) length, count(*) filter (where selected and coverage >= 0.6) hidden from listed group by 1,2)
select image_id, layer_id, coalesce(islands, 0) island_count, coalesce(made, 0) bridges_created, cast(floor(coalesce(cov, 0)*100+0.5) as int) average_coverage, cast(floor(coalesce(length, 0)+0.5) as int) average_bridge_length,
 cast(floor(coalesce(hidden/nullif(made, 0)::DOUBLE*100, 0)+0.5) as int) hidden_bridge_percentage from (select distinct image_id, layer_id from mk) left join a using (image_id, layer_id)""",
    "p06_preview_modes": f"""with c as (select image_id, 0 layer_id, x, y, r, g, b, case when a=0 then 0 else b end a, image_id%5 t from {THUMBS}),
k as (select *, case t when 1 then substr({STACK_SQL}[image_id%8+1], 2) when 2 then '333' when 0 then '333' when 3 then 'A1b2C3' else '' end h from c),
v as (select *, case when substr(h,1,2)='' then 0 else ('0x'||substr(h,1,2))::int end hr, case when substr(h,3,2)='' then 0 else ('0x'||substr(h,3,2))::int end hg, case when substr(h,5,2)='' then 0 else ('0x'||substr(h,5,2))::int end hb from k)
select image_id, layer_id, x, y, case when t<3 and a=0 then 0 when t=0 then r else hr end r, case when t<3 and a=0 then 0 when t=0 then g else hg end g, case when t<3 and a=0 then 0 when t=0 then b else hb end b,
 case when t<3 then a when a > 128 then 255 else 0 end a from v""",
    "e06_linked_width": f"select image_id, cast(h as int) height_mm, cast(floor(h*(width/height::DOUBLE)+0.5) as bigint) width_mm from {SIZE.format(v=POSTERS)}, range(10, 100) t(h)",
    "s01_s04_png_pixels": f"select image_id, x, y, r, g, b, a, luma from {lit(THUMBS)}",
    "s08_layer_pngs": f"select m.image_id, layer_id, m.x, m.y, r, g, b from {masks(THUMBS)} m join {THUMBS} p on p.image_id=m.image_id and p.x=m.x and p.y=m.y",
    "s06_rewritten_layer": f"select image_id, layer_id, case when layer_id=1 then 7-x else x end x, y from {masks(THUMBS)} where layer_id in (1, 2)",
    "r01_arriving_pictures": leaders(THUMBS, 8),
    "k01_colour_count": leaders(SWATCHES, 24),
    "r04_late_edits": f"""with e as (select session_id, event_id, ts, event_id%5 k from {EDITS}), m as (select k, max(ts) t from e group by 1), w as (select j.k, max(m.t) - interval 3 days mark from m j join m on m.k < j.k group by 1)
select session_id, event_id, mark is null or ts >= mark accepted from e left join w using (k)""",
    "s02_decode_data_urls": f"select upload_id, regexp_extract(url, '^data:([^;,]*)', 1) mime, octet_length(from_base64(split_part(url, ',', 2))) n_bytes, md5(from_base64(split_part(url, ',', 2))) md5 from {URLS} where url like 'data:image/%'",
    "s05_shrink": f"""with s as (select p.*, width, height, least(1.0::DOUBLE, 12.0::DOUBLE/greatest(width,height)) k from {SWATCHES} p join {SIZE.format(v=SWATCHES)} using (image_id))
select image_id, cast(floor(x*floor(width*k+0.5)/width) as int) x, cast(floor(y*floor(height*k+0.5)/height) as int) y, {", ".join(f"cast(floor(avg({c})+0.5) as int) {c}" for c in "rgba")} from s group by image_id, 2, 3""",
    "s07_file_names": f"select 'stencil-layer-' || lpad(cast(layer_id+1 as varchar),2,'0') || '.svg' file, count(*) n_pixels from {masks(THUMBS)} group by layer_id",
    "s09_enlarged_pixels": f"""with p as (select image_id, x, y, case when a > 0 then r else 255 end r, case when a > 0 then g else 255 end g, case when a > 0 then b else 255 end b from {THUMBS}),
q as (select image_id, x*4+i x, y*4+j y, r, g, b from p, range(4) t(i), range(4) u(j)) select image_id, count(*) n, cast(sum(r*(x+1)) as bigint) sr, cast(sum(g*(y+1)) as bigint) sg, cast(sum(b) as bigint) sb from q group by 1""",
    "p01_luma": f"select image_id, x, y, luma from {lit(THUMBS)}",
    "p02_opaque": f"select image_id, count(*) n, cast(sum(r) as bigint) sum_r from {SWATCHES} where a >= 10 group by 1",
    "p03_near_white": f"select image_id, cast(count(*) filter (where least(r,g,b) > 240) as bigint) strict_15, count(*) filter (where least(r,g,b) >= 240) wide_15, count(*) filter (where least(r,g,b) >= 195) wide_60 from {THUMBS} group by 1",
    "p04_binarise": f"select image_id, {', '.join(f'count(*) filter (where a > {c}) over_{c}' for c in (0, 10, 128))} from {THUMBS} group by 1",
    "p05_stride_sample": f"select image_id, cast(y as bigint)*width+x idx, r, g, b, a from {POSTERS} p join {SIZE.format(v=POSTERS)} using (image_id) where (cast(y as bigint)*width+x) % greatest(1, cast(floor(width*height/5000) as bigint)) = 0",
    "p06_recolour": f"select image_id, layer_id, x, y, cast('0x'||substr(c,2,2) as int) r, cast('0x'||substr(c,4,2) as int) g, cast('0x'||substr(c,6,2) as int) b from (select *, {STACK_SQL}[layer_id%8+1] c from {masks(THUMBS)})",
    "p07_hex": f"select image_id, x, y, '#' || printf('%02x%02x%02x', r, g, b) hex, case when x=7 then 0 else r end r, case when x=7 then 0 else g end g, case when x=7 then 0 else b end b from {THUMBS}",
    "p08_layer_texts": f"""select layer_id, case when layer_id=0 then 'Layer 1 (Black)' when layer_id=3 then 'Layer 4 (White)' else 'Layer ' || (layer_id+1) end as name,
 case when layer_id=0 then 'Darkest (0–' || cast(floor(upper/255::DOUBLE*100+0.5) as int) || '%)' else 'Tones ' || cast(floor(lower/255::DOUBLE*100+0.5) as int) || '–' || cast(floor(upper/255::DOUBLE*100+0.5) as int) || '%' end description, n_pixels
 from {BANDS} b join (select layer_id, count(*) n_pixels from {masks(THUMBS)} group by 1) using (layer_id)""",
    "p09_clamped_thresholds": f"select event_id, array_to_string(list_transform(range(4), lambda i: case when i = layer_id or layer_id < 2 and i < 2 then least(254, greatest(1, value)) else [60,60,100,150][i+1] end), ',') limits from {EDITS} where setting='threshold'",
    "p10_marker_scale": f"with m as (select image_id, width*(image_id%7) w from {SIZE.format(v=POSTERS)}), k as (select *, greatest(1.0::DOUBLE, w/500.0::DOUBLE) k from m) select image_id, w, cast(floor(k*14+0.5) as int) arm, cast(greatest(1, floor(k*3+0.5)) as int) thick, cast(floor(k*24+0.5) as int) margin from k",
    "t01_thresholds": f"select n_layers, layer_id, upper, count(*) n_under from {lit(THUMBS)} p join {values([*range(2, 13), 14])} on luma < upper where a >= 10 group by 1,2,3",
    "t02_layer_masks": f"select * from {masks(SWATCHES)}",
    "t03_bands": f"select image_id, x, y, layer_id, luma from {lit(SWATCHES)} p join {BANDS} b on lower <= luma and luma < upper where a >= 10",
    "t04_band_colours": f"select * from {colours(SWATCHES)}",
    "w1_tone_preview": preview(THUMBS),
    "x01_composite": preview(SWATCHES),
    "k03_assign": f"with {SEEDS}, {NEAR} select image_id, x, y, k from near",
    "k04_update": f"with {SEEDS}, {NEAR}, m as (select image_id, k, avg(r) mr, avg(g) mg, avg(b) mb from near group by 1,2) select s.image_id, s.k, cast(floor(coalesce(mr,s.r)+0.5) as int) r, cast(floor(coalesce(mg,s.g)+0.5) as int) g, cast(floor(coalesce(mb,s.b)+0.5) as int) b from seeds s left join m using (image_id, k)",
    "k06_colour_layers": f"""with recursive {reach("least(r,g,b) >= 240")}, bg as (select distinct image_id, comp_id from l where idx%8 in (0,7) or idx//8 in (0,7)), gone as (select l.image_id, idx%8 x, idx//8 y from l join bg using (image_id, comp_id)),
{SEEDS}, {NEAR} select image_id, k layer_id, x, y from near anti join gone using (image_id, x, y)""",
    "k07_paint_order": f"with {SEEDS} select image_id, k, row_number() over (partition by image_id order by (0.299::DOUBLE*r+0.587::DOUBLE*g+0.114::DOUBLE*b)/255, k)-1 paint_order from seeds",
    "n01_blur": f"with p as (select image_id, x, y, luma from {lit(THUMBS)}), h as (select *, cast({blur_pass('luma', 'x', 'y', 3)} as float) hh from p) select image_id, x, y, cast(floor({blur_pass('hh', 'y', 'x', 3)}+0.5) as int) luma from h",
    "n02_dilate": f"""with o as (select i dx, j dy from range(-2,3) t(i), range(-2,3) u(j) where i*i+j*j <= 4), g as (select distinct m.image_id, layer_id, cast(x+dx as int) x, cast(y+dy as int) y from {DARK} m cross join o join {SIZE.format(v=SWATCHES)} s using (image_id) where x+dx between 0 and width-1 and y+dy between 0 and height-1)
select * from {runs("g")}""",
    "n03_boundary": f"""with d as (select image_id, x, y, a >= 10 and luma < 100 ink from {lit(SWATCHES)}) select image_id, x, y, ink from (select *, coalesce(lag(ink) over r, ink) l, coalesce(lead(ink) over r, ink) rr, coalesce(lag(ink) over c, ink) u, coalesce(lead(ink) over c, ink) dn from d window r as (partition by image_id, y order by x), c as (partition by image_id, x order by y)) where l<>ink or rr<>ink or u<>ink or dn<>ink""",
    "c01_components": f"with recursive {reach('luma >= 100')} select image_id, comp_id, idx%8 x, idx//8 y from l",
    "c02_facts": f"with recursive {reach('luma >= 100')} select image_id, comp_id, count(*) area, bool_or(idx%8 in (0,7) or idx//8 in (0,7)) touches_border, round(avg(idx%8), 6) cx, round(avg(idx//8), 6) cy from l group by 1,2",
    "c03_specks": f"with recursive {reach('luma >= 100')} select image_id, idx%8 x, idx//8 y from (select *, count(*) over (partition by image_id, comp_id) n from l) where n >= 4",
    "c04_holes": HOLES,
    "c05_background": f"with recursive {reach('least(r,g,b) >= 195')}, t as (select distinct image_id, comp_id from l where idx%8 in (0,7) or idx//8 in (0,7)) select l.image_id, idx%8 x, idx//8 y from l join t using (image_id, comp_id)",
    "c06_mainland": f"with recursive {reach('luma >= 100')}, f as (select image_id, comp_id, count(*) area from l group by 1,2), k as (select *, row_number() over (partition by image_id order by area desc, comp_id) n from f) select image_id, comp_id, area, case when n=1 then 'mainland' else 'island' end as role from k where n=1 or area >= 2",
    "b01_even_sample": f"with p as (select image_id, cast(y as bigint)*24+x idx, row_number() over (partition by image_id order by y, x)-1 r, count(*) over (partition by image_id) n from {SWATCHES}), w as (select image_id, n, cast(floor(i*(n/20::DOUBLE)) as bigint) r from (select distinct image_id, n from p), range(20) t(i)) select p.image_id, idx from p semi join w on p.image_id=w.image_id and p.r=w.r where n > 20 union all select image_id, idx from p where n <= 20",
    "b04_sectors": f"select image_id, x, y, case when {away('0')} <= {away('(2*pi()/3)')} and {away('0')} <= {away('(4*pi()/3)')} then 0 when {away('(2*pi()/3)')} <= {away('(4*pi()/3)')} then 1 else 2 end sector from {SWATCHES}",
    "b05_line_pixels": f"select distinct image_id, 0 sx, y sy, r%40 tx, g%40 ty, cast(greatest(r%40, abs(g%40-y))+1 as bigint) n, 0 x_min, r%40 x_max, least(y, g%40) y_min, greatest(y, g%40) y_max from {THUMBS} where x=0",
    "b07_crossings": f"with {EDGES}, p as (select a.doc_id, a.contour_id c1, b.contour_id c2, a.nx-a.x ux, a.ny-a.y uy, b.nx-b.x vx, b.ny-b.y vy, b.x-a.x wx, b.y-a.y wy from e a join e b on a.doc_id=b.doc_id and a.contour_id < b.contour_id), q as (select *, ux*vy-uy*vx det from p) select doc_id, c1, c2, count(*) n from q where {CROSS.format(m='0.01::DOUBLE')} group by 1,2,3",
    "v01_paths": f"select doc_id, cast(n-1 as int) path_id, d from (select doc_id, unnest(regexp_extract_all(svg, 'd=\"([^\"]*)\"', 1)) d, generate_subscripts(regexp_extract_all(svg, 'd=\"([^\"]*)\"', 1), 1) n from {SVGS})",
    "v02_flatten": f"select doc_id, (dense_rank() over (partition by doc_id order by contour_id)-1)*4294967296 contour_id, seq, x, y from {RINGS}",
    "v03_areas": f"with {AREAS} select doc_id, contour_id, round(area, 6) area from ar",
    "v04_mainland": f"with {AREAS} select doc_id, contour_id, role from ro",
    "v06_feet": f"with {CANDS} select doc_id, contour_id, count(*) n, min(round(d2, 6)) d2 from cand group by 1,2",
    "v07_v08_shortest_bridges": f"""with {CANDS}, j as (select c.doc_id, c.contour_id, c.seq, c.edge, fx-c.x ux, fy-c.y uy, w.nx-w.x vx, w.ny-w.y vy, w.x-c.x wx, w.y-c.y wy from cand c join e w on w.doc_id=c.doc_id and w.contour_id<>c.contour_id and w.contour_id<>c.mainland),
k as (select *, ux*vy-uy*vx det from j), bad as (select distinct doc_id, contour_id, seq, edge from k where {CROSS.format(m='1e-4::DOUBLE')})
select doc_id, contour_id, seq, edge, round(d2, 6) d2 from (select *, row_number() over (partition by doc_id, contour_id order by d2, seq, edge) n from cand anti join bad using (doc_id, contour_id, seq, edge)) where n=1""",
    "v11_path_strings": f"select * from {path(f'(select doc_id, contour_id, seq, x/8 x, y/4 y from {RINGS})')}",
    "v12_documents": f"""select doc_id, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 1000 1000" width="1000" height="1000">' || string_agg('<path d="' || d || '" fill="#123456" fill-rule="evenodd"/>', '' order by contour_id) || '</svg>' svg from {path(RINGS)} group by 1""",
    "e01_runs": f"select * from {runs(masks(SWATCHES))}",
    "e02_mask_svg": f"""select image_id, layer_id, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 8 8" width="8" height="8"><rect width="8" height="8" fill="white"/><path d="' || string_agg('M ' || x0 || ' ' || y0 || ' H ' || (x1+1) || ' V ' || (y1+1) || ' H ' || x0 || ' Z', ' ' order by y0, x0) || '" fill="' || {STACK_SQL}[layer_id%8+1] || '"/></svg>' svg from {BOXES.format(r=runs(masks(THUMBS)))} group by 1,2""",
    "e03_outlines": f"with recursive {OUTLINES} select image_id, 0 layer_id, contour_id, cast(row_number() over (partition by image_id, first order by n)-1 as int) seq, x, y from rg join wk using (image_id, first) join cn on cn.image_id=wk.image_id and cn.code=wk.cur join nx on nx.image_id=wk.image_id and nx.code=wk.cur",
    "e04_raster_marks": f"""with m as (select image_id, x+24 x, y+24 y from {DARK_THUMBS}), i as (select distinct image_id from m), c as (select * from (values (12,12),(44,12),(12,44),(44,44)) t(cx,cy)),
k as (select image_id, cx+a x, cy+d y from i, c, range(-14,15) t(a), range(-1,2) u(d) union select image_id, cx+d, cy+a from i, c, range(-14,15) t(a), range(-1,2) u(d))
select image_id, x, y from m union select image_id, x, y from k where x between 0 and 55 and y between 0 and 55""",
    "e05_svg_marks": f"""select image_id, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 48 48" width="48" height="48"><rect width="48" height="48" fill="white"/><g transform="translate(20,20)"><path d="' || string_agg('M ' || x0 || ' ' || y0 || ' H ' || (x1+1) || ' V ' || (y1+1) || ' H ' || x0 || ' Z', ' ' order by y0, x0) || '" fill="#000000"/></g><g id="corner-markers">{MARKS}</g></svg>' svg from {BOXES.format(r=runs(DARK_THUMBS))} group by 1""",
    "e06_physical_size": f"""select image_id, cast(floor((image_id%90+10)/(8/6::DOUBLE)+0.5) as bigint) height_mm, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 8 8" width="' || (image_id%90+10) || 'mm" height="' || cast(floor((image_id%90+10)/(8/6::DOUBLE)+0.5) as bigint) || 'mm"' head from (select distinct image_id from {DARK_THUMBS})""",
    "x02_stack_colours": f"select event_id, {STACK_SQL}[event_id%8+1] color from {EDITS}",
    "x03_merged_layers": f"select image_id, layer_id, x, y from {masks(THUMBS)} where layer_id > 1 union all select distinct image_id, 0, x, y from {masks(THUMBS)} where layer_id < 2",
    "x04_duplicated_layer": f"select * from {masks(THUMBS)} union all select image_id, 9, x, y from {masks(THUMBS)} where layer_id = 0",
    "r02_bursts": f"""with v as (select *, case when ts - lag(ts) over w < interval 6 hours then 0 else 1 end n from {EDITS} window w as (partition by session_id order by ts, event_id)), g as (select *, sum(n) over (partition by session_id order by ts, event_id) k from v)
select session_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') first_ts, count(*) n_events, arg_max(value, (ts, event_id)) last_value from g group by session_id, k""",
    "r03_folded_state": f"with {LIVE} select session_id, layer_id, cast(count(*) filter (where setting='toggle') % 2 as bigint) hidden, coalesce(arg_max(value, (ts, event_id)) filter (where setting='threshold'), -1) threshold, coalesce(arg_max(value, (ts, event_id)) filter (where setting='color'), -1) color from lv group by 1,2",
    "s03_data_url_round_trip": f"select distinct image_id, 'image/png' mime, true same, '0000000800000008' size from {THUMBS}",
    "t01_preset_colours": f"select n_layers, layer_id, color, count(*) n_over from {lit(THUMBS)} p join (select * from {presets(range(2, 13))} union all select * from {presets(range(14, 15))}) on luma >= upper where a >= 10 group by 1,2,3",
    "x01_canvas": f"""with m as (select image_id, x, y, max(layer_id) layer_id from {masks(THUMBS)} where layer_id <> 1 or image_id%3 <> 0 group by 1,2,3)
select image_id, coalesce({STACK_SQL}[layer_id%8+1], 'transparent') color, count(*) n_pixels from {THUMBS} p left join m using (image_id, x, y) group by 1,2""",
    "k02_farthest_seeds": f"with {palette(4, 0)} select image_id, k, cast(r as int) r, cast(g as int) g, cast(b as int) b from pal0",
    "k02_weighted_seeds": f"with {weighted_seeds(4)} select * from ws4",
    "k05_corpus_palette": f"with {corpus_palette(6, 3, 12, 12)} select k, cast(floor(r+0.5) as int) r, cast(floor(g+0.5) as int) g, cast(floor(b+0.5) as int) b from cp12",
    "k05_palette": f"with {palette(4, 12)} select * from pal",
    "v09_rectangles": f"with {CANDS}, first as (select * from (select *, row_number() over (partition by doc_id, contour_id order by d2, seq, edge) n from cand) where n=1), {corners('first')} select doc_id, contour_id, {', '.join(f'round({c}{k}, 6) {c}{k}' for k in range(4) for c in 'xy')} from corner",
    "v10_bridged_paths": f"with {BEST}, {corners('best')}, b as (select doc_id, count(*) n from corner group by 1) select doc_id, count(*) + coalesce(any_value(n), 0) n_paths, coalesce(any_value(n), 0) n_bridges from (select distinct doc_id, contour_id from e) left join b using (doc_id) group by 1",
    "t05_tone_layers": f"with recursive {cleaned(SWATCHES, 24, 2, 5)} select image_id, layer_id, count(*) ink from whole group by 1,2",
    "b15_bridged_stack": f"""with recursive mk as materialized (select image_id, layer_id, y*8+x idx from {masks(THUMBS)}), {banks(THUMBS, 8, 0)}, {sources(20)}, {realistic_stack(4, 8, 2)}
select image_id, layer_id, count(e.idx) ink from (select distinct image_id, layer_id from mk) l left join ({' union all '.join(f'select * from er{k}' for k in range(4))}) e using (image_id, layer_id) group by 1,2""",
    "w1_realistic_stack": f"""with recursive {cleaned(THUMBS, 8, 2, 3)}, mk as materialized (select * from whole), {banks(THUMBS, 8, 0)}, {sources(20)}, {realistic_stack(4, 8, 2)},
be as (select image_id, layer_id, count(*) ink from mk group by 1,2), af as (select image_id, layer_id, count(*) ink_left from ({' union all '.join(f'select * from er{k}' for k in range(4))}) group by 1,2),
bs as (select image_id, layer_id, count(distinct island) island_count, count(*) filter (where selected) bridges_created from ({' union all '.join(f'select image_id, layer_id, island, selected from listed{k}' for k in range(4))}) group by 1,2),
cl as (select image_id, layer_id, cast(floor(sum(r)/count(*)+0.5) as int) r, cast(floor(sum(g)/count(*)+0.5) as int) g, cast(floor(sum(b)/count(*)+0.5) as int) b from sf join {BANDS} bb on lower <= luma and luma < upper where a >= 10 group by 1,2)
select i.image_id, t.layer_id, case when t.layer_id=0 then 'Layer 1 (Black)' when t.layer_id=3 then 'Layer 4 (White)' else 'Layer ' || (t.layer_id+1) end as name,
 '#' || printf('%02x%02x%02x', coalesce(r,0), coalesce(g,0), coalesce(b,0)) color, coalesce(ink, 0) ink, coalesce(ink_left, 0) ink_left, coalesce(island_count, 0) island_count, coalesce(bridges_created, 0) bridges_created
from (select distinct image_id from sf) i cross join {BANDS} t left join cl using (image_id, layer_id) left join be using (image_id, layer_id) left join af using (image_id, layer_id) left join bs using (image_id, layer_id)""",
    "w3_simplified_documents": f"""with recursive v as materialized (select * from {RINGS}), part as (select doc_id, contour_id, min(seq) a, max(seq) b from v group by 1,2 union all
 select doc_id, contour_id, unnest([a, k]), unnest([k, b]) from (select doc_id, contour_id, a, b, arg_max(seq, (d, -seq)) k, max(d) d from (select p.*, m.seq,
  case when y.x=x.x and y.y=x.y then sqrt((m.x-x.x)*(m.x-x.x)+(m.y-x.y)*(m.y-x.y)) else abs((m.x-x.x)*(y.y-x.y)-(m.y-x.y)*(y.x-x.x))/sqrt((y.x-x.x)*(y.x-x.x)+(y.y-x.y)*(y.y-x.y)) end d
  from part p join v m on m.doc_id=p.doc_id and m.contour_id=p.contour_id and m.seq > p.a and m.seq < p.b join v x on x.doc_id=p.doc_id and x.contour_id=p.contour_id and x.seq=p.a join v y on y.doc_id=p.doc_id and y.contour_id=p.contour_id and y.seq=p.b) group by 1,2,3,4) where d > 12),
sim as materialized (select v.* from v semi join (select doc_id, contour_id, unnest([a, b]) seq from part) k using (doc_id, contour_id, seq)), {BEST.replace(RINGS, "sim")}, {corners('best')}
select doc_id, count(*) + coalesce(any_value(n), 0) n_paths from (select distinct doc_id, contour_id from v) left join (select doc_id, count(*) n from corner group by 1) using (doc_id) group by 1""",
    "w3_bridged_documents": f"""with {BEST}, {corners('best')}, paths as (select doc_id, 0 part, contour_id, d from {path(RINGS)} union all
 select doc_id, 1, contour_id, 'M ' || {" || ' L ' || ".join(f"{NUM.format(v=f'x{k}')} || ' ' || {NUM.format(v=f'y{k}')}" for k in range(4))} || ' Z' from corner)
select doc_id, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 1000 1000" width="1000" height="1000">' || string_agg('<path d="' || d || '" fill="#123456" fill-rule="evenodd"/>', '' order by part, contour_id) || '</svg>' svg from paths group by 1""",
    "w1_realistic_layers": f"""with recursive p0 as (select image_id, x, y, r, g, b, a, luma from {lit(THUMBS)}), h as (select *, cast({blur_pass('luma', 'x', 'y', 2)} as float) hh from p0),
sf as materialized (select image_id, x, y, r, g, b, a, cast(floor({blur_pass('hh', 'y', 'x', 2)}+0.5) as int) luma from h),
mk as materialized (select image_id, layer_id, y*8+x idx from sf join {FOUR} on {INSIDE} where a >= 10), {reached('ink', 'mk')},
big as materialized (select image_id, layer_id, idx from (select *, count(*) over (partition by image_id, layer_id, comp_id) n from ink) where n >= 3),
gap as materialized (select l.image_id, l.layer_id, cast(i as int) idx from (select distinct image_id, layer_id from mk) l cross join range(64) t(i) anti join big b on b.image_id=l.image_id and b.layer_id=l.layer_id and b.idx=i), {reached('hole', 'gap')},
inner_holes as (select image_id, layer_id, comp_id from hole group by 1,2,3 having count(*) < 3 and not bool_or(idx%8 in (0,7) or idx//8 in (0,7))),
done as (select image_id, layer_id, count(*) ink from (select * from big union all select image_id, layer_id, idx from hole semi join inner_holes using (image_id, layer_id, comp_id)) group by 1,2),
cl as (select image_id, layer_id, cast(floor(sum(r)/count(*)+0.5) as int) r, cast(floor(sum(g)/count(*)+0.5) as int) g, cast(floor(sum(b)/count(*)+0.5) as int) b from sf join {BANDS} bb on lower <= luma and luma < upper where a >= 10 group by 1,2)
select i.image_id, t.layer_id, case when t.layer_id=0 then 'Layer 1 (Black)' when t.layer_id=3 then 'Layer 4 (White)' else 'Layer ' || (t.layer_id+1) end as name,
 case when t.layer_id=0 then 'Darkest (0–' || cast(floor(upper/255::DOUBLE*100+0.5) as int) || '%)' else 'Tones ' || cast(floor(lower/255::DOUBLE*100+0.5) as int) || '–' || cast(floor(upper/255::DOUBLE*100+0.5) as int) || '%' end description,
 lower, upper, '#' || printf('%02x%02x%02x', coalesce(r,0), coalesce(g,0), coalesce(b,0)) color, coalesce(ink, 0) ink
from (select distinct image_id from sf) i cross join {BANDS} t left join cl using (image_id, layer_id) left join done using (image_id, layer_id)""",
    "w2_colour_layers": f"""with recursive {reach("least(r,g,b) >= 240")}, bg as (select distinct image_id, comp_id from l where idx%8 in (0,7) or idx//8 in (0,7)), gone as (select l.image_id, idx from l join bg using (image_id, comp_id)),
{palette(3, 12)}, ord as materialized (select *, row_number() over (partition by image_id order by (0.299::DOUBLE*r+0.587::DOUBLE*g+0.114::DOUBLE*b)/255, k)-1 layer_id from pal),
flat as materialized (select image_id, idx, layer_id from (select *, row_number() over (partition by image_id, idx order by d, k) n from (select p.image_id, p.idx, o.k, o.layer_id, {SQUARE.format(a="p", b="o")} d from px p join ord o using (image_id))) where n=1),
mask as (select * from flat anti join gone using (image_id, idx)),
bled as (select distinct image_id, layer_id, idx%8+dx x, idx//8+dy y from mask, (values (0,0),(1,0),(-1,0),(0,1),(0,-1)) o(dx,dy) where (layer_id > 0 or dx=0 and dy=0) and idx%8+dx between 0 and 7 and idx//8+dy between 0 and 7)
select o.image_id, cast(o.layer_id as int) layer_id, 'Color ' || (k+1) as name, upper('#' || printf('%02x%02x%02x', r, g, b)) description, '#' || printf('%02x%02x%02x', r, g, b) color, coalesce(ink, 0) ink
from ord o left join (select image_id, layer_id, count(*) ink from bled group by 1,2) using (image_id, layer_id)""",
    "w2_colour_stack": f"""with recursive cnt as materialized ({leaders(THUMBS, 8)}), {reach("least(r,g,b) >= 240")}, bg as (select distinct image_id, comp_id from l where idx%8 in (0,7) or idx//8 in (0,7)), gone as (select l.image_id, idx from l join bg using (image_id, comp_id)),
{palette(20, 12, "image_id in (select image_id from cnt where n_colors > {k})")}, ord as materialized (select *, row_number() over (partition by image_id order by (0.299::DOUBLE*r+0.587::DOUBLE*g+0.114::DOUBLE*b)/255, k)-1 layer_id from pal),
flat as materialized (select image_id, idx, layer_id from (select *, row_number() over (partition by image_id, idx order by d, k) n from (select p.image_id, p.idx, o.k, o.layer_id, {SQUARE.format(a="p", b="o")} d from px p join ord o using (image_id))) where n=1),
mk as materialized (select distinct image_id, layer_id, (idx//8+dy)*8+idx%8+dx idx from (select * from flat anti join gone using (image_id, idx)), (values (0,0),(1,0),(-1,0),(0,1),(0,-1)) o(dx,dy) where (layer_id > 0 or dx=0 and dy=0) and idx%8+dx between 0 and 7 and idx//8+dy between 0 and 7),
{banks(THUMBS, 8, 1)}, {sources(8, 't.mainland', f"case when layer_id > 0 or {OPPOSING[0]} <= {OPPOSING[1]} and {OPPOSING[0]} <= {OPPOSING[2]} then 0 when {OPPOSING[1]} <= {OPPOSING[2]} then 1 else 2 end")},
sg as (select distinct image_id, layer_id, sx, sy, tx, ty from ca), si as (select distinct image_id, sx, sy, tx, ty from ca), {line_members('si')}, tp as (select image_id, idx, max(layer_id) top from mk group by 1,2),
cv as (select g.image_id, g.layer_id, sx, sy, tx, ty, count(*) filter (where top > g.layer_id)/count(*)::DOUBLE coverage from sg g join ln using (image_id, sx, sy, tx, ty) left join tp on tp.image_id=g.image_id and tp.idx=ln.y*8+ln.x group by 1,2,3,4,5,6),
fo as materialized (select * from ca join cv using (image_id, layer_id, sx, sy, tx, ty)), {chosen(2)}, sj as (select distinct image_id, sx::int sx, sy::int sy, tx::int tx, ty::int ty from sl), {numbered(line_members('sj'), 100)},
st as (select distinct s.image_id, s.layer_id, (l.y+b)*8+l.x+a idx from sl s join ln100 l using (image_id, sx, sy, tx, ty), range(-1, 2) t(a), range(-1, 2) u(b) where l.x+a between 0 and 7),
er as (select image_id, idx, max(layer_id) layer_id from mk anti join st using (image_id, layer_id, idx) group by 1,2)
select t.image_id, coalesce('#' || printf('%02x%02x%02x', o.r, o.g, o.b), 'transparent') color, count(*) n_pixels from {THUMBS} t left join er on er.image_id=t.image_id and er.idx=t.y*8+t.x left join ord o on o.image_id=er.image_id and o.layer_id=er.layer_id group by 1,2""",
    "r03_settings": f"with {STATE} select session_id, mode, n_layers from st",
    "r03_layer_state": f"""with {STATE}, si as (select session_id, max((ts, event_id)) s from lv where setting='layers' group by 1), ed as (select lv.* from lv left join si using (session_id) where setting in ('threshold','color') and (s is null or (ts, event_id) > s)),
li as (select session_id, l layer_id, arg_max(least(254, greatest(1, value)), (ts, event_id)) lim from (select *, unnest(case when layer_id < 2 then [0,1] else [layer_id] end) l from ed where setting='threshold') group by 1,2),
co as (select session_id, layer_id, arg_max(value, (ts, event_id)) shade from ed where setting='color' group by 1,2), tg as (select session_id, layer_id, count(*)%2 hidden from lv where setting='toggle' group by 1,2)
select session_id, t.layer_id, n_layers, mode, coalesce(lim, upper) upper, coalesce('#' || lpad(printf('%X', shade), 6, '0'), color) color, coalesce(hidden, 0) hidden
from st join {presets(range(2, 22))} using (n_layers) left join li using (session_id, layer_id) left join co using (session_id, layer_id) left join tg using (session_id, layer_id)""",
    "b02_b03_thumb_targets": f"with recursive {targets(*THUMB_STACK)} select * from ca",
    "b06_thumb_coverage": f"with recursive {covered(*THUMB_STACK, 3)} select image_id, layer_id, island, sector, sx, sy, tx, ty, target, round(coverage, 6) coverage from fo",
    "b08_thumb_best": f"with recursive {covered(*THUMB_STACK, 3)}, {best_of('image_id, layer_id, island, sector, sx, sy, tx, ty, target')}",
    "b02_b03_targets": f"with recursive {targets(*SWATCH_STACK)} select * from ca",
    "b06_coverage": f"with recursive {covered(*SWATCH_STACK, 2, 't.mainland')} select image_id, layer_id, island, sector, sx, sy, tx, ty, round(coverage, 6) coverage from fo",
    "b08_best_candidates": f"with recursive {covered(*SWATCH_STACK, 2, 't.mainland')}, {best_of('image_id, layer_id, island, sector, sx, sy, tx, ty')}",
    "b11_b13_simple_plan": f"with recursive {SIMPLE} select image_id, layer_id, island, anchor, sx, sy, tx, ty, target from sm union all select image_id, layer_id, island, anchor, sx, sy, tx, ty, -1 from sh",
    "b05_line_members": f"with recursive sg as (select distinct image_id, 0 sx, y sy, r%20 tx, g%20 ty from {THUMBS} where x=0), {line_members('sg')} select image_id, sx, sy, tx, ty, seq, x, y from ln",
    "s07_mode_file_names": f"select 'stencil-' || mode || '-layer-' || (layer_id+1) || '.svg' file, count(*) n_pixels from {masks(THUMBS)}, (values ('realistic'), ('cartoon')) m(mode) group by layer_id, mode",
}
