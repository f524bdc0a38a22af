"""Operators for preparing training text: one module per operator, all over a ``documents`` table.

Nothing else in the library imports this subpackage. Shared conventions:

* Only the named input columns are read, so extra columns of any name never clash.
* A null text is an empty text. A null ``doc_id`` sorts before every other id and is one id of its own.
* A row is known by its ``doc_id`` and text: identical rows get identical results, and every row is returned.
* Intermediate tables go to the folder in ``spark.checkpoint.dir``; ``session.release`` removes them after use.
"""
