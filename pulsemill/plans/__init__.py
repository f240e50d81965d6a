"""Storage, ledgers and runners."""
