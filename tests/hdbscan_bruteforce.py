"""Single-machine HDBSCAN written straight from the published algorithm
(Campello et al. 2013; McInnes et al. 2017), for checking small inputs only:
mutual reachability, Prim tree, single-linkage merges, top-down condensation,
excess-of-mass selection, epsilon merge, labels."""
import numpy as np


def hdbscan_bruteforce(X, mcs, ms, eps=0.0):
    X = np.asarray(X, dtype=float)
    n = len(X)
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    ms = max(1, min(ms, n - 1))
    core = np.sort(D, axis=1)[:, ms]
    MR = np.maximum(D, np.maximum(core[:, None], core[None, :]))
    # Kruskal over all pairs in the canonical order (weight, low id, high id):
    # mutual reachability has many equal weights, and the merge order under
    # ties shapes the condensed tree, so the order is fixed here as in Spark
    iu, ju = np.triu_indices(n, 1)
    order = np.lexsort((ju, iu, MR[iu, ju]))
    uf = list(range(n))

    def root_of(a):
        while uf[a] != a:
            uf[a] = uf[uf[a]]; a = uf[a]
        return a
    edges = []
    for t in order:
        a, b = int(iu[t]), int(ju[t])
        ra, rb = root_of(a), root_of(b)
        if ra != rb:
            uf[ra] = rb
            edges.append((MR[a, b], a, b))
    # single linkage dendrogram: node ids n.. ; children, distance, size
    parent = list(range(2 * n)); size = [1] * n + [0] * n
    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]; a = parent[a]
        return a
    left, right, dist = {}, {}, {}
    nxt = n
    for w, a, b in edges:
        ra, rb = find(a), find(b)
        left[nxt], right[nxt], dist[nxt] = ra, rb, w
        size[nxt] = size[ra] + size[rb]
        parent[ra] = parent[rb] = nxt
        nxt += 1
    root = nxt - 1

    def leaves(node):
        out, st = [], [node]
        while st:
            x = st.pop()
            if x < n: out.append(x)
            else: st += [left[x], right[x]]
        return out

    # condense top-down
    rows = []  # parent, child, lam, size ; child < 0 encodes point -(p+1)
    label_of = {root: 0}; next_label = 1
    st = [root]
    while st:
        node = st.pop()
        if node < n: continue
        c = label_of[node]
        lam = np.inf if dist[node] == 0 else 1.0 / dist[node]
        l, r = left[node], right[node]
        sl, sr = size[l], size[r]
        if sl >= mcs and sr >= mcs:
            for ch in (l, r):
                label_of[ch] = next_label; rows.append((c, next_label, lam, size[ch])); next_label += 1
                st.append(ch)
        elif sl < mcs and sr < mcs:
            for p in leaves(l) + leaves(r): rows.append((c, -(p + 1), lam, 1))
        else:
            small, big = (l, r) if sl < mcs else (r, l)
            for p in leaves(small): rows.append((c, -(p + 1), lam, 1))
            label_of[big] = c; st.append(big)
    birth = {0: 0.0}
    for p_, ch, lam, s in rows:
        if ch >= 0: birth[ch] = lam
    stab = {k: 0.0 for k in birth}
    for p_, ch, lam, s in rows:
        stab[p_] += (lam - birth[p_]) * s
    kids = {}
    for p_, ch, lam, s in rows:
        if ch >= 0: kids.setdefault(p_, []).append(ch)
    clusters = sorted(k for k in birth if k != 0)
    is_c = {c: True for c in clusters}
    for c in sorted(clusters, reverse=True):
        sub = sum(stab[k] for k in kids.get(c, []))
        if sub > stab[c]:
            is_c[c] = False; stab[c] = sub
        else:
            st = list(kids.get(c, []))
            while st:
                x = st.pop(); is_c[x] = False; st += kids.get(x, [])
    sel = {c for c in clusters if is_c[c]}
    par = {ch: p_ for p_, ch, lam, s in rows if ch >= 0}
    if eps > 0 and sel:
        new = set()
        for leaf in sel:
            if 1.0 / birth[leaf] < eps:
                x = leaf
                while True:
                    p_ = par[x]
                    if p_ == 0: break
                    if 1.0 / birth[p_] > eps: x = p_; break
                    x = p_
                new.add(x)
            else:
                new.add(leaf)
        # a chosen cluster below another chosen one is dropped
        def anc(c):
            while c in par and par[c] != 0:
                c = par[c]; yield c
        sel = {c for c in new if not any(a in new for a in anc(c))}
    lab = np.full(n, -1)
    for p_, ch, lam, s in rows:
        if ch < 0:
            c = p_
            while c != 0 and c not in sel:
                c = par[c]
            if c != 0: lab[-ch - 1] = c
    # renumber by smallest member
    out = np.full(n, -1)
    firsts = sorted((np.flatnonzero(lab == c).min(), c) for c in set(lab) if c != -1)
    for i, (_, c) in enumerate(firsts): out[lab == c] = i
    return out
