"""DataFrame -> DataFrame operators; no actions except in ``longtext.pack_document``, which runs in passes."""
