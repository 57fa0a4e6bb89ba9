"""Cross-page text repair and analytics over page/line tables, expressed as Spark plans."""
