"""sifthall: a Spark-first engine for document-compliance analytics.

Every public function takes DataFrames (and plain parameters) and returns a DataFrame; nothing here starts a
session, collects data-sized results or keeps state outside the folders it is given.
"""
