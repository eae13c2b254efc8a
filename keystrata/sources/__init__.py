"""Where operations come from: tables read as op logs, traces, durable stores."""
