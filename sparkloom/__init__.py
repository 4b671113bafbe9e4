"""sparkloom: document analytics and retrieval operators expressed as Spark jobs."""
