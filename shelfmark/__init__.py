"""Record linkage and metadata reconciliation over catalogue records, as DataFrame plans."""
