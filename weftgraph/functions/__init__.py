"""Part of weftgraph."""
