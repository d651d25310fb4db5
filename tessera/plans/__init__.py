"""Formula language: parsing, canonical form, and planning over panels."""
