"""Planning of repairs and the bounded repair loop, as DataFrame stages."""
