"""Every operator as a query over the driver's tables, with the SQL that checks it."""
