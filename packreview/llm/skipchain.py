"""A conditional random field over tokens with links between distant ones, and loopy message passing in numpy.

Nodes have log-linear potentials over their features; neighbours in a chain share transition potentials, and linked
tokens, the same or similar ones anywhere in a document, share potentials over entity kinds. Many documents are one
graph here: what is not linked does not interact. Messages go over all edges at once, at most ROUNDS times, with
damping, as the graph has loops; on a graph without loops they settle at the exact marginals.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ROUNDS, SETTLED, DAMP = 24, 1e-3, 0.3
NEVER = -30.0


@dataclass
class Graph:
    """features: numbers of each node's features, one node after another; sizes: how many each has; edges: (node, node, kind of
    edge), kind 0 from a token to the next one, 1 and 2 between the same and similar ones; first: nodes without a neighbour
    before them, which begin an entity if they are in one; label: the known label of a node or -1."""

    features: np.ndarray
    sizes: np.ndarray
    edges: np.ndarray
    first: np.ndarray
    label: np.ndarray


@dataclass
class Field:
    """Labels are 0 for none, then begin and inside of each kind of entity."""

    kinds: int
    unary: np.ndarray  # (features, labels)
    chain: np.ndarray  # (labels, labels)
    links: np.ndarray  # (2, kinds + 1, kinds + 1), symmetric

    @classmethod
    def blank(cls, kinds: int, features: int) -> Field:
        """No feature says anything; linked tokens rather share their kind than not."""
        labels = 1 + 2 * kinds
        links = np.zeros((2, kinds + 1, kinds + 1))
        links[:, range(1, kinds + 1), range(1, kinds + 1)] = 2.5
        links[:, 0, 0] = 1.0
        return cls(kinds, np.zeros((features, labels)), np.zeros((labels, labels)), links)

    @property
    def kind_of(self) -> np.ndarray:
        return np.concatenate([[0], np.repeat(np.arange(1, self.kinds + 1), 2)])

    def potentials(self) -> np.ndarray:
        """(4, labels, labels): along the chain, against it, same, similar. An inside follows its own kind alone."""
        kind, chain = self.kind_of, self.chain.copy()
        for label in range(2, len(kind), 2):
            chain[kind != kind[label], label] = NEVER
        links = self.links[:, kind][:, :, kind]
        return np.stack([chain, chain.T, links[0], links[1]])

    def node_scores(self, g: Graph, known: bool) -> np.ndarray:
        """Log potentials of the nodes; with `known` their labels are held where they are known."""
        starts = np.cumsum(g.sizes) - g.sizes
        s = np.add.reduceat(self.unary[g.features], starts) if len(starts) else np.zeros((0, self.unary.shape[1]))
        s[np.ix_(g.first, range(2, s.shape[1], 2))] += NEVER
        if known:
            held = np.flatnonzero(g.label >= 0)
            s[held] += 2 * NEVER
            s[held, g.label[held]] -= 2 * NEVER
        return s


def _normal(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def beliefs(field: Field, g: Graph, known: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the nodes (nodes, labels) and of the edges (edges, labels, labels), as far as messages settle them."""
    own = field.node_scores(g, known)
    if not len(g.edges):
        return np.exp(_normal(own)), np.zeros((0, own.shape[1], own.shape[1]))
    u, v, kind = g.edges.T
    n, labels = own.shape
    # messages 0..e go from u to v, the rest back
    src, dst, e = np.concatenate([u, v]), np.concatenate([v, u]), len(u)
    pot = np.exp(field.potentials())
    sort = np.concatenate([np.where(kind == 0, 0, kind + 1), np.where(kind == 0, 1, kind + 1)])
    of_sort = [np.flatnonzero(sort == s) for s in range(4)]
    back = np.concatenate([np.arange(e) + e, np.arange(e)])
    m = np.full((2 * e, labels), -np.log(labels))
    sums = lambda: own + np.stack([np.bincount(dst, m[:, k], n) for k in range(labels)], axis=1)
    for _ in range(ROUNDS):
        sent = np.exp(_normal(sums()[src] - m[back]))
        new = np.empty_like(m)
        for s, rows in enumerate(of_sort):
            new[rows] = np.log(sent[rows] @ pot[s] + 1e-30)
        new = (1 - DAMP) * _normal(new) + DAMP * m
        moved = np.abs(new - m).max()
        m = new
        if moved < SETTLED:
            break
    total = sums()
    a, b = np.exp(_normal(total[u] - m[e:])), np.exp(_normal(total[v] - m[:e]))
    pairs = a[:, :, None] * pot[sort[:e]] * b[:, None, :]
    return np.exp(_normal(total)), pairs / pairs.sum(axis=(1, 2), keepdims=True)


def _counts(field: Field, g: Graph, known: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    node, pair = beliefs(field, g, known)
    unary, chain, links = np.zeros_like(field.unary), np.zeros_like(field.chain), np.zeros_like(field.links)
    of = np.repeat(np.arange(len(g.sizes)), g.sizes)
    for k in range(unary.shape[1]):
        unary[:, k] = np.bincount(g.features, node[of, k], len(unary))
    if len(g.edges):
        kind, k = g.edges[:, 2], field.kind_of
        chain += pair[kind == 0].sum(axis=0)
        for s in (1, 2):
            both = pair[kind == s].sum(axis=0)
            np.add.at(links[s - 1], (k[:, None], k[None, :]), both + both.T)
    return unary, chain, links / 2


def learn(g: Graph, kinds: int, features: int, steps: int = 80, rate: float = 0.3, prior: float = 0.02) -> Field:
    """Fits all potentials to the known labels: counts with the labels held less those without, under the messages' marginals.
    Labels that are unknown are summed over. A Gaussian prior stands about Field.blank."""
    field, at = Field.blank(kinds, features), Field.blank(kinds, features)
    if not (g.label > 0).any():
        field.unary[:, 0] += 1.0  # nothing has been seen but tokens outside entities
        return field
    names = ("unary", "chain", "links")
    seen = [np.full_like(getattr(field, n), 1e-3) for n in names]
    for _ in range(steps):
        with_, free = _counts(field, g, True), _counts(field, g, False)
        for k, name in enumerate(names):
            grad = with_[k] - free[k] - prior * (getattr(field, name) - getattr(at, name))
            seen[k] += grad**2
            setattr(field, name, getattr(field, name) + rate * grad / np.sqrt(seen[k]))
    return field
