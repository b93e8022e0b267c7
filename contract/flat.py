"""The flat form of the test events: one SQL text that both Spark and DuckDB accept.

Spark builds log envelopes from it, and DuckDB answers every query from it directly, so the two
sides share no JSON step.
"""

FLAT_SQL = """
SELECT *,
 CASE WHEN event_name='gemini_cli.api_response' AND event_id%30<>0
      THEN input_tokens+output_tokens END AS total_tokens,
 CASE WHEN event_name='gemini_cli.tool_call' AND event_id%5=4 THEN concat('server-', event_id%3) END AS mcp_server_name
FROM (
SELECT event_id, ts, user_id, event_type, value, props, event_name,
 concat('id-', event_id) AS insert_id,
 CASE WHEN event_name='gemini_cli.api_error' OR event_type='error' THEN 'ERROR' ELSE 'INFO' END AS severity,
 CASE WHEN user_id%25<>0 THEN concat('user', user_id%25, '@example.com') END AS user_email,
 concat('s-', user_id, '-', event_id%3) AS session_id,
 concat('inst-', user_id%40) AS installation_id,
 concat('proj-', user_id%3) AS resource_project_id,
 CASE WHEN event_id%40<>0 THEN concat('model-', event_id%3) END AS model,
 CASE WHEN event_id%60<>0 THEN concat('0.', event_id%4, '.0') END AS cli_version,
 CASE WHEN event_id%17=0 THEN concat('op-', event_id) END AS operation_id,
 CASE WHEN event_id%19=0 THEN concat('trace-', event_id%7) END AS trace,
 CASE WHEN event_name='gemini_cli.api_response' THEN CAST(floor(value*10) AS BIGINT) END AS input_tokens,
 CASE WHEN event_name='gemini_cli.api_response' THEN CAST(floor(value*3) AS BIGINT) END AS output_tokens,
 CASE WHEN event_name='gemini_cli.api_response' THEN event_id%100 END AS cached_tokens,
 CASE WHEN event_name='gemini_cli.api_response' THEN event_id%7 END AS thoughts_tokens,
 CASE WHEN event_name='gemini_cli.api_response' THEN event_id%5 END AS tool_tokens,
 CASE WHEN event_name='gemini_cli.api_response' THEN CAST(event_id%10 AS DOUBLE)/10 END AS temperature,
 CASE WHEN event_name='gemini_cli.api_response' THEN CAST(event_id%20 AS DOUBLE)/20 END AS top_p,
 CASE WHEN event_name='gemini_cli.api_response' THEN event_id%64 END AS top_k,
 CASE WHEN event_name='gemini_cli.api_response' THEN 1000+event_id%100 END AS max_output_tokens,
 CASE WHEN event_name='gemini_cli.api_response' AND event_id%9=0 THEN 'STOP' END AS finish_reason,
 CASE WHEN event_name='gemini_cli.api_response' AND event_id%3=0 THEN event_id%50 END AS gen_ai_input_tokens,
 CASE WHEN event_name='gemini_cli.api_response' AND event_id%3=0 THEN event_id%40 END AS gen_ai_output_tokens,
 CAST(CASE WHEN event_name='gemini_cli.api_response' THEN 200
      WHEN event_name='gemini_cli.api_error' AND event_id%8 IN (0,1) THEN 429
      WHEN event_name='gemini_cli.api_error' AND event_id%8=4 THEN 500
      WHEN event_name='gemini_cli.api_error' THEN 503 END AS BIGINT) AS status_code,
 CASE WHEN event_name='gemini_cli.api_error' AND event_id%8 IN (0,1) THEN 'RATE_LIMIT'
      WHEN event_name='gemini_cli.api_error' THEN 'SERVER'
      WHEN event_name='gemini_cli.tool_call' AND event_type='error' THEN 'TOOL_ERROR' END AS error_code,
 CASE WHEN event_name='gemini_cli.api_error' AND event_id%16<>0
      THEN concat('request failed for "model-', event_id%3, '"') END AS error_message,
 CASE WHEN event_name='gemini_cli.api_error' AND event_id%3<>0 THEN 'boom' END AS error,
 CASE WHEN event_name IN ('gemini_cli.api_response','gemini_cli.api_error','gemini_cli.tool_call')
      THEN value*2+0.5 END AS duration_ms,
 CASE WHEN event_name='gemini_cli.tool_call' AND event_id%5=0 THEN 'read_file'
      WHEN event_name='gemini_cli.tool_call' AND event_id%5=1 THEN 'write_file'
      WHEN event_name='gemini_cli.tool_call' AND event_id%5=2 THEN 'shell'
      WHEN event_name='gemini_cli.tool_call' AND event_id%5=3 THEN 'web_search'
      WHEN event_name='gemini_cli.tool_call' THEN 'mcp_query' END AS function_name,
 CASE WHEN event_name='gemini_cli.tool_call' THEN props END AS function_args,
 CASE WHEN event_name='gemini_cli.tool_call' THEN event_type<>'error' END AS function_success,
 CASE WHEN event_name='gemini_cli.tool_call' AND event_id%5=4 THEN 'mcp'
      WHEN event_name='gemini_cli.tool_call' THEN 'native' END AS tool_type,
 CASE WHEN event_name='gemini_cli.model_routing' AND event_id%3=0 THEN 'classifier'
      WHEN event_name='gemini_cli.model_routing' AND event_id%3=1 THEN 'default'
      WHEN event_name='gemini_cli.model_routing' THEN 'override' END AS decision_source,
 CASE WHEN event_name='gemini_cli.model_routing' THEN CASE WHEN event_id%8<4 THEN 'model-0' ELSE 'model-1' END END AS decision_model,
 CASE WHEN event_name='gemini_cli.model_routing' THEN event_id%5=0 END AS failed,
 CASE WHEN event_name='gemini_cli.model_routing' THEN event_id%500 END AS routing_latency_ms,
 CASE WHEN event_name='gemini_cli.chat_compression' AND event_id%64=1 THEN 0
      WHEN event_name='gemini_cli.chat_compression' THEN 1000+event_id%5000 END AS tokens_before,
 CASE WHEN event_name='gemini_cli.chat_compression' THEN event_id%800 END AS tokens_after,
 CASE WHEN event_name='gemini_cli.conversation_finished' AND event_id%3=0 THEN 'default'
      WHEN event_name='gemini_cli.conversation_finished' AND event_id%3=1 THEN 'auto_edit'
      WHEN event_name='gemini_cli.conversation_finished' THEN 'yolo' END AS approval_mode,
 CASE WHEN event_name='gemini_cli.conversation_finished' THEN 1+event_id%12 END AS turn_count,
 CASE WHEN event_name='gemini_cli.config' THEN event_id%4=0 END AS sandbox_enabled,
 CASE WHEN event_name='gemini_cli.config' THEN event_id%9=0 END AS log_user_prompts_enabled,
 CASE WHEN event_name='gemini_cli.config' AND event_id%4=0 THEN 'text'
      WHEN event_name='gemini_cli.config' THEN 'json' END AS output_format,
 CASE WHEN event_name='gemini_cli.config' AND event_id%12<>0 THEN concat('ext-a,ext-', event_id%5) END AS extensions,
 CASE WHEN event_name='gemini_cli.config' THEN event_id%7 END AS extension_count,
 CASE WHEN event_id%13=0 THEN '[{"part":"Tool_Call"}]' END AS output_messages
FROM (SELECT *, CASE
 WHEN event_type='view' THEN 'gemini_cli.api_response'
 WHEN event_type='click' AND event_id%2=0 THEN 'gemini_cli.api_response'
 WHEN event_type='click' THEN 'gemini_cli.tool_call'
 WHEN event_type='purchase' AND event_id%4=0 THEN 'gemini_cli.model_routing'
 WHEN event_type='purchase' AND event_id%4=1 THEN 'gemini_cli.chat_compression'
 WHEN event_type='purchase' AND event_id%4=2 THEN 'gemini_cli.conversation_finished'
 WHEN event_type='purchase' THEN 'gemini_cli.slash_command'
 WHEN event_type='signup' AND event_id%6=0 THEN 'gemini_cli.config'
 WHEN event_type='signup' AND event_id%6=1 THEN 'gemini_cli.agent.start'
 WHEN event_type='signup' AND event_id%6=2 THEN 'gemini_cli.extension_install'
 WHEN event_type='signup' AND event_id%6=3 THEN 'gemini_cli.flash_fallback'
 WHEN event_type='signup' AND event_id%6=4 THEN 'gemini_cli.chat.content_retry'
 WHEN event_type='signup' THEN 'gemini_cli.chat.content_retry_failure'
 WHEN event_id%4 IN (0,1) THEN 'gemini_cli.api_error'
 WHEN event_id%4=2 THEN 'gemini_cli.tool_call'
 ELSE 'gemini_cli.malformed_json_response' END AS event_name FROM events) e0) e1
"""
