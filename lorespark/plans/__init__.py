"""Registered queries, each beside the SQL that states the same result."""


def load():
    """The registry, after all query modules have put theirs into it."""
    from lorespark.plans import q_graph, q_models, q_notes, q_small, q_text, q_vectors, registry  # noqa: F401

    return registry
