"""Part of the contract engine."""
