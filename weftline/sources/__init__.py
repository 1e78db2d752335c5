"""Source adapters: payload tables (bundle_id, source, payload) to raw records. A source that cannot be read gives no
records and an audit event; it never fails the job."""
