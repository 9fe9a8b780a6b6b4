"""What a person reads: numbers, tables, JSON and pages, made on the driver from results that are small by nature."""
