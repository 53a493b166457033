"""Files in and out: slide listings, CSV and GeoJSON, state documents, tiles, manifests."""
