"""Duplicate removal and overlap resolution inside one row's hit array.

Both only compare hits that can touch.  A running maximum over the hits in
start order cuts them into clusters (a cluster ends where the next hit starts past everything
seen), and the work stays inside a cluster: pair by pair in a small one, by a sweep
with bisections in a large one, such as thousands of hits inside one long address.
"""

from .core import HITS_TYPE, NO_HITS, leading, let, running


def per_cluster(hits: str, work) -> str:
    """Apply ``work(var)`` to every cluster of touching hits; ``hits`` sorted by start."""
    reach = running("transform(pc_all, pc_h -> pc_h.`end`)", "0", lambda a, x: f"greatest({a}, {x})")
    firsts = "filter(sequence(0, size(pc_all) - 1), pc_i -> get(pc_all, pc_i).start >= get(pc_r, pc_i))"
    clusters = ("transform(pc_f, (pc_s, pc_k) -> slice(pc_all, pc_s + 1, "
                "coalesce(get(pc_f, pc_k + 1), size(pc_all)) - pc_s))")
    done = f"transform({clusters}, pc_g -> case when size(pc_g) > 1 then {work('pc_g')} else pc_g end)"
    split = let("pc_r", reach, let("pc_f", firsts, f"flatten({done})"))
    return let("pc_all", hits, f"case when size(pc_all) < 2 then pc_all else {split} end")


#: Clusters of up to this many hits are compared pair by pair; larger ones are swept.
PAIRWISE = 64


def drop_contained(hits: str) -> str:
    """Drop a hit lying inside a same-type hit that scores at least as high."""
    beaten = ("dc_o.entity_type = dc_h.entity_type and dc_o.start <= dc_h.start and dc_o.`end` >= dc_h.`end` "
              "and (dc_o.score > dc_h.score or (dc_o.score = dc_h.score and "
              "(dc_o.start < dc_h.start or dc_o.`end` > dc_h.`end` or dc_o.pattern_id < dc_h.pattern_id)))")

    def work(group):
        pairs = f"filter({group}, dc_h -> not exists({group}, dc_o -> {beaten}))"
        return f"case when size({group}) <= {PAIRWISE} then {pairs} else {_swept(group)} end"

    return per_cluster(hits, work)


def _swept(group: str) -> str:
    """``drop_contained`` of a large cluster: in an order in which whatever beats a hit comes before it.

    The reaches that no other outdoes are carried along: for every type the furthest end of each score. A hit is beaten
    if one of its type ends no earlier and scores no less. There are as many as types and distinct scores at most.
    """
    order = ("case when dc_a.start <> dc_b.start then dc_a.start - dc_b.start when dc_a.`end` <> dc_b.`end` then dc_b.`end` - dc_a.`end` "
             "when dc_a.score <> dc_b.score then if(dc_a.score > dc_b.score, -1, 1) else dc_a.pattern_id - dc_b.pattern_id end")
    reach = "array<struct<t:string,e:int,s:double>>"
    beaten = "exists(dc_c.reach, dc_p -> dc_p.t = dc_h.entity_type and dc_p.e >= dc_h.`end` and dc_p.s >= dc_h.score)"
    left = "filter(dc_c.reach, dc_p -> not (dc_p.t = dc_h.entity_type and dc_h.`end` >= dc_p.e and dc_h.score >= dc_p.s))"
    own = "array(named_struct('t', dc_h.entity_type, 'e', dc_h.`end`, 's', dc_h.score))"
    step = (f"named_struct('reach', cast(concat({left}, {own}) as {reach}), 'kept', cast(concat(dc_c.kept, array(dc_h)) as {HITS_TYPE}))")
    start = f"named_struct('reach', cast(array() as {reach}), 'kept', {NO_HITS})"
    return (f"sort_array(aggregate(array_sort({group}, (dc_a, dc_b) -> {order}), {start}, (dc_c, dc_h) -> case when {beaten} then dc_c else {step} end, "
            f"dc_c -> dc_c.kept))")


def resolve_overlaps(hits: str) -> str:
    """Keep disjoint hits: best score first, then longer, then earlier, then by type name.

    The hits kept so far stay in order of their start, so a bisection finds the only one that a hit may clash with.
    """
    def greedy(group):
        ranked = (f"sort_array(transform({group}, ro_h -> named_struct('a', -ro_h.score, "
                  f"'b', ro_h.start - ro_h.`end`, 'c', ro_h.start, 'd', ro_h.entity_type, 'hit', ro_h)))")
        near = leading("size(ro_a)", lambda i: f"get(ro_a, {i}).start < ro_r.hit.`end`")
        added = f"cast(concat(slice(ro_a, 1, ro_n), array(ro_r.hit), slice(ro_a, ro_n + 1, size(ro_a))) as {HITS_TYPE})"
        step = let("ro_n", near, f"case when ro_n > 0 and get(ro_a, ro_n - 1).`end` > ro_r.hit.start then ro_a else {added} end")
        many = f"aggregate({ranked}, {NO_HITS}, (ro_a, ro_r) -> {step})"
        clash = "exists(ro_a, ro_k -> ro_k.start < ro_r.hit.`end` and ro_r.hit.start < ro_k.`end`)"
        few = (f"sort_array(aggregate({ranked}, {NO_HITS}, (ro_a, ro_r) -> case when {clash} then ro_a "
               f"else cast(concat(ro_a, array(ro_r.hit)) as {HITS_TYPE}) end))")
        return f"case when size({group}) <= {PAIRWISE} then {few} else {many} end"

    return per_cluster(hits, greedy)
